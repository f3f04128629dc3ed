"""How five text filters act together: for every order of them, what each step removes, and exact Shapley shares.

Every text fails some of the five filters, which gives one of 32 patterns. All that any order of filters does
follows from how many documents each coalition (set of filters) removes together, so the documents are counted
by source and pattern, and the 32 coalition removals of each source are tabulated from its 32 counts. A step of
an order adds one filter to a coalition; differences of two removals are its counts.

Shapley shares come from the same table by least squares: the additive model of the removals that fits all
coalitions best under Shapley's kernel weights, with shares that sum to the removal of all five. Its normal equations are
solved in rationals, so shares are exact; times 120 they are sums over all orders.

Filters (a text fails if): A: under 200 words; B: fewer than half of the words are distinct; C: more than 2 % of the
code points are A-Z; D: it holds one of ``#$%&*|``; E: a document with a smaller doc_id has the same text.

Defined results: a NULL text is empty; a NULL source counts to the part of the empty string; a document counts as good
(toxic) if any of its label rows says so, label rows without a document count nowhere; repeated rows all count, and rows that
repeat the smallest doc_id of a text do not fail E; rows without doc_id never fail E and have no labels; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 200
SIGNS = b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COALITIONS = 1 << len(FILTERS)
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}"


def failed(text: str) -> int:
    """Bits of the filters A to D that the text fails (A: 1, B: 2, ...)."""
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 2 * len(text)) << 2
        | (len(data.translate(None, SIGNS)) < len(data)) << 3
    )


def _facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, 16-byte digest of the text and the bits of A to D, for every row; no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bits = [], []
            for item in batch["text"]:
                text = item.as_py() or ""
                digests.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                bits.append(failed(text))
            columns = [batch["doc_id"], batch["part"], pa.array(digests, pa.binary()), pa.array(bits, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "fails"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, fails int")


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of all five filters), n, good and toxic: counts of documents.

    A large group of copies is one row for each part and label before its digest is shuffled, so no task gets the group.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    marked = _facts(docs).join(said, "doc_id", "left").select("doc_id", "part", "digest", "fails", *marks)
    same = ["digest", "part", "fails", "good", "toxic"]
    rows = marked.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    groups = rows.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0) + F.col("without_id")
    split = groups.withColumn("smallest", smallest).withColumn("firsts", firsts)
    both = F.array(
        F.struct(F.col("fails"), F.col("firsts").alias("n")),
        F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("firsts")).alias("n")),
    )
    return split.select("part", "good", "toxic", F.inline(both)).groupBy("part", "fails").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def removals(counts: list[int]) -> list[int]:
    """For each coalition, how many fail at least one of its filters; ``counts`` by pattern."""
    return [sum(n for fails, n in enumerate(counts) if fails & s) for s in range(COALITIONS)]


def _solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    rows = [[*row, value] for row, value in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(j for j in range(i, len(rows)) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(len(rows)):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [row[-1] for row in rows]


def shapley(value: list[int]) -> list[Fraction]:
    """Shapley shares of the filters in ``value`` (by coalition, the empty one 0), by kernel-weighted least squares.

    Minimizes the weighted squares of value(S) - sum of shares in S over all S but none and all, under the constraint that
    all shares sum to value(all): the stationary point of the Lagrangian, solved in rationals.
    """
    n = len(FILTERS)
    square = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [Fraction(0)] * n + [Fraction(value[-1])]
    for size in range(1, n):
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        for members in combinations(range(n), size):
            coalition = sum(1 << i for i in members)
            for i in members:
                right[i] += weight * value[coalition]
                for j in members:
                    square[i][j] += weight
    for i in range(n):
        square[i][n] = square[n][i] = Fraction(1)
    return _solve(square, right)[:n]


def steps(counts: list[tuple[int, int, int, int]]) -> list[tuple]:
    """All orders and steps from (fails, n, good, toxic) rows of one part: rows of RESULT without the part."""
    table = [[0] * COALITIONS for _ in range(3)]
    for fails, *row in counts:
        for kind, n in enumerate(row):
            table[kind][fails] += n
    total = sum(table[0])
    every, good, toxic = map(removals, table)
    shares = [share * factorial(len(FILTERS)) for share in shapley(every)]
    made = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            after = before | own
            removed = every[after] - every[before]
            alone = every[-1] - every[COALITIONS - 1 - own]
            made.append(
                (order, step, total - every[after], removed, every[own] - removed, alone,
                 good[after] - good[before], toxic[after] - toxic[before], int(shares[FILTERS.index(name)]))
            )
            before = after
    return made


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """RESULT: one row per part, order and step. ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic."""
    by_part = patterns(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("counts"))
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                rows = steps([tuple(c.values()) for c in counts.as_py()])
                columns = [[part.as_py()] * len(rows), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return by_part.mapInArrow(run, RESULT)
