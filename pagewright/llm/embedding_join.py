"""Near duplicates among embeddings: an epsilon grid order join.

Vectors of length one whose cosine is at least ``t`` are at most eps = sqrt(2 - 2 t) apart, and no projection onto
orthonormal directions takes them further apart. So vectors are put in the order of their cells in a grid of width eps on
their leading principal directions. The sequence is cut into blocks, blocks into intervals of FAN blocks, and so
on; pairs of intervals are joined top down, each pair of one level giving the pairs of its children, unless their boxes
on the principal directions are more than eps apart. Each pair of blocks that is left is joined in a task of its own, which
halves both sides further and skips in the same way, and compares what is left in full.

The principal directions are fitted on ``SAMPLE`` vectors at most. They only decide how much is skipped: any orthonormal
directions give the same links.

Equal vectors are one class with a count before anything is compared, so a large group of copies is one row. Tasks emit, per
class, the number of links and the smallest class it is tied with, never the links themselves.

A cosine is that of the vectors as given, in double precision; where rounding could decide, by rational arithmetic.

Defined results: vectors that are NULL, empty or zero, or hold NULL or non-finite components, link with nothing, and
so do rows without vec_id; a shorter vector counts as padded with zeros; rows that repeat a vec_id all count as vectors, and are one
node in components; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.components import components
from pagewright.llm.sampling import bounded_sample
from pagewright.storage import materialize

SAMPLE = 2_000
DIRECTIONS = 8
BLOCK_BYTES = 4 << 20  # of a block's vectors in double precision
FAN = 8
LEAF = 128
SLACK = 1e-9  # far above rounding, far below any threshold's step
TIE = 1e-12


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as doubles, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    made = np.zeros((len(column), width))
    made[np.arange(width) < lengths[:, None]] = values
    return made


def principal_directions(vectors: np.ndarray, directions: int) -> np.ndarray:
    """Orthonormal columns along which the vectors spread most."""
    _, _, rows = np.linalg.svd(vectors - vectors.mean(axis=0), full_matrices=False)
    return np.linalg.qr(rows[:directions].T)[0]


def surely(a: np.ndarray, b: np.ndarray, cosine: Fraction) -> bool:
    """Whether the cosine reaches the threshold, in rationals."""
    x, y = ([Fraction(v) for v in row.tolist()] for row in (a, b))
    dot = sum(p * q for p, q in zip(x, y, strict=True))
    return dot >= 0 and dot * dot >= cosine * cosine * sum(p * p for p in x) * sum(q * q for q in y)


class Side:
    """One block of a pair in grid order: vectors, their units, places on the directions, and how many rows each stands for."""

    def __init__(self, vectors: np.ndarray, places: np.ndarray, copies: np.ndarray):
        self.vectors, self.units, self.places, self.copies = vectors, units(vectors), places, copies.astype(np.float64)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.vectors)

    def box(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if (start, end) not in self.boxes:
            part = self.places[start:end]
            self.boxes[start, end] = part.min(axis=0), part.max(axis=0)
        return self.boxes[start, end]


class BlockJoin:
    """Links between two blocks, or within one (``right`` is ``left``)."""

    def __init__(self, left: Side, right: Side, cosine: float):
        self.left, self.right, self.cosine = left, right, cosine
        self.exact = Fraction(str(cosine))
        self.reach = 2 - 2 * cosine + SLACK
        self.same = left is right
        n = len(left) + (0 if self.same else len(right))
        self.shift = 0 if self.same else len(left)
        self.links, self.label = np.zeros(n), np.arange(n)
        self.compared = 0

    def distant(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        (low, high), (lower, higher) = self.left.box(*a), self.right.box(*b)
        gap = np.maximum(0, np.maximum(low - higher, lower - high))
        return float(gap @ gap) > self.reach

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        if self.distant(a, b):
            return
        if a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF:
            self.compare(a, b)
            return
        halves = [[(s, m), (m, e)] if (m := (s + e) // 2) > s else [(s, e)] for s, e in (a, b)]
        for i, x in enumerate(halves[0]):
            for j, y in enumerate(halves[1]):
                if not (self.same and a == b and i > j):
                    self.join(x, y)

    def compare(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        self.compared += 1
        near = self.left.units[slice(*a)] @ self.right.units[slice(*b)].T
        linked = near >= self.cosine
        for i, j in np.argwhere(np.abs(near - self.cosine) < TIE):
            linked[i, j] = surely(self.left.vectors[a[0] + i], self.right.vectors[b[0] + j], self.exact)
        if self.same and a == b:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        self.links[slice(*a)] += linked @ self.right.copies[slice(*b)]
        if not (self.same and a == b):
            self.links[self.shift + b[0] : self.shift + b[1]] += self.left.copies[slice(*a)] @ linked
        i, j = np.nonzero(linked)
        self.tie(a[0] + i, self.shift + b[0] + j)

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        """Give linked classes the smallest label of their component so far."""
        while True:
            x, y = self.label[i], self.label[j]
            if (x == y).all():
                return
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.label, high, low)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _classes(frame: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows as vec_id and key (NULL where nothing can link), and classes: key, first vec_id, copies, vec."""
    vector = F.col(column)
    # Adding 0 makes the negative zero a positive one.
    text = F.array_join(F.transform(vector, lambda x: (x + F.lit(0).cast("float")).cast("string")), ",")
    rows = frame.select(
        "vec_id", F.when(F.col("vec_id").isNotNull() & valid(vector), F.unhex(F.md5(text))).alias("key"), vector.alias("vec")
    )
    rows = materialize(rows)
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("vec").alias("vec")
    )
    return rows.select("vec_id", "key"), materialize(classes)


def _sequence(classes: DataFrame, eps: float, directions: int, sample: int, block_bytes: int) -> DataFrame:
    """The classes with their places on the principal directions and their blocks, numbered in grid order."""
    spark = classes.sparkSession
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    width = size["width"] or 1
    rows = bounded_sample(classes, sample, "key").select("vec").toArrow()["vec"].combine_chunks()
    basis = principal_directions(units(matrix(rows, width)), directions) if len(rows) else np.zeros((width, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = units(matrix(batch["vec"], width)) @ basis
            extra = [pa.array(list(np.floor(at / eps).astype(np.int32)), pa.list_(pa.int32())), pa.array(list(at), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "cell", "at"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    placed = materialize(classes.mapInArrow(place, f"{kinds}, cell array<int>, at array<double>"))
    per_block = max(LEAF, block_bytes // (8 * width))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // per_block)), -(-size["n"] // (64 * per_block)))
    # Places go on inside a partition, whose number is in the upper bits; written once, they stay as they are.
    ordered = placed.repartitionByRange(parts, "cell", "at", "key").sortWithinPartitions("cell", "at", "key")
    numbered = materialize(ordered.withColumn("_number", F.monotonically_increasing_id()))
    part, number = F.shiftright("_number", 33), F.col("_number").bitwiseAND((1 << 33) - 1)
    numbered = numbered.withColumns({"part": part, "turn": number})
    sizes = numbered.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col("part").alias("own"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    joined = numbered.join(F.broadcast(firsts), F.col("part") == F.col("own")).withColumn("turn", F.col("before") + F.col("turn"))
    # Blocks go on from one partition to the next, so their number depends on the number of classes alone.
    block = F.floor(F.col("turn") / per_block).cast("long")
    return materialize(joined.select("key", "first", "copies", "vec", "at", "turn", block.alias("block")))


def _near_blocks(sequence: DataFrame, reach: float) -> DataFrame:
    """Pairs a <= b of blocks that are not provably distant, by levels of intervals from all blocks down."""
    numbers = range(len(sequence.select("at").first()["at"]))
    places = [F.get("at", F.lit(d)) for d in numbers]
    ends = [f(p).alias(f"{name}{d}") for name, f in (("low", F.min), ("high", F.max)) for d, p in enumerate(places)]
    boxes = materialize(sequence.groupBy("block").agg(*ends))
    count, levels = boxes.count(), 0
    while FAN**levels < count:
        levels += 1

    def level(height: int, name: str) -> DataFrame:
        """Intervals of FAN ** height blocks as ``name``, with their parents."""
        interval = F.floor(F.col("block") / FAN**height).cast("long")
        ends = [f(f"{end}{d}").alias(f"{name}_{end}{d}") for end, f in (("low", F.min), ("high", F.max)) for d in numbers]
        rows = boxes.groupBy(interval.alias(name)).agg(*ends)
        return rows.withColumn(f"{name}_parent", F.floor(F.col(name) / FAN).cast("long"))

    def gap(d: int) -> Column:
        apart = F.greatest(F.lit(0.0), F.col(f"a_low{d}") - F.col(f"b_high{d}"), F.col(f"b_low{d}") - F.col(f"a_high{d}"))
        return apart * apart

    pairs = sequence.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for height in range(levels - 1, -1, -1):
        parents = pairs.select(F.col("a").alias("a_of"), F.col("b").alias("b_of"))
        pairs = parents.join(level(height, "a"), F.col("a_parent") == F.col("a_of")).join(level(height, "b"), F.col("b_parent") == F.col("b_of"))
        pairs = pairs.where((F.col("a") <= F.col("b")) & (sum(map(gap, numbers), F.lit(0.0)) <= reach)).select("a", "b")
    return materialize(pairs)


def links(classes: DataFrame, cosine: float, directions: int = DIRECTIONS, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per pair of blocks and class with links there: key, first, n_links (rows linked) and the first vec_id of a class it is tied with."""
    eps = math.sqrt(2 - 2 * cosine)
    sequence = _sequence(classes, eps, directions, sample, block_bytes)
    kind = dict(classes.dtypes)["first"]
    result = f"key binary, first {kind}, n_links long, tied {kind}"
    if not sequence.head(1):
        return classes.sparkSession.createDataFrame([], result)
    pairs = _near_blocks(sequence, 2 - 2 * cosine + SLACK)
    sides = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("block")
    members = pairs.select("a", "b", sides).join(sequence, "block")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("block", "ascending"), ("turn", "ascending")])
        column = lambda name: table[name].combine_chunks()
        blocks = column("block").to_numpy()
        vec, at = column("vec"), column("at")
        vectors = matrix(vec, max(1, int(np.diff(vec.offsets.to_numpy()).max())))
        places, copies = matrix(at, len(at[0])), column("copies").to_numpy()
        cut = int(np.searchsorted(blocks, blocks[-1]))
        last = Side(vectors[cut:], places[cut:], copies[cut:])
        left = Side(vectors[:cut], places[:cut], copies[:cut]) if cut else last
        work = BlockJoin(left, last, cosine)
        work.join((0, len(left)), (0, len(last)))
        hit = np.flatnonzero(work.links)
        tied = table["first"].take(pa.array(work.label[hit]))
        return table.select(["key", "first"]).take(pa.array(hit)).append_column(
            "n_links", pa.array(np.rint(work.links[hit]).astype(np.int64))
        ).append_column("tied", tied)

    found = members.select("a", "b", "block", "turn", "key", "first", "copies", "vec", "at").groupBy("a", "b").applyInArrow(run, result)
    return materialize(found)


def near_duplicates(frame: DataFrame, cosine: float = 0.95, column: str = "embedding", **options) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``frame``; options as for ``links``."""
    rows, classes = _classes(frame, column)
    found = links(classes, cosine, **options)
    sums = found.groupBy("key").agg(F.sum("n_links").alias("others"))
    edges = found.select(F.col("first").alias("a"), F.col("tied").alias("b"))
    tied = components(edges)
    # Only classes of several rows or with links; all other rows need no partner in the last join.
    told = classes.select("key", "first", "copies").join(sums, "key", "left").where("copies > 1 OR others IS NOT NULL")
    told = told.join(tied, F.col("first") == F.col("node"), "left").select(
        "key",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "first").alias("component_id"),
    )
    whole = rows.join(told, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
