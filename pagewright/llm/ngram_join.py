"""Similarity self-join on word n-grams with several global token orders.

Two sets can only reach the threshold if they share a token among the first few of either, in any order that
is the same for all sets. Such a prefix filter is applied under several orders and the filters intersected:

1. By rarity. Document frequencies are counted over the whole corpus in two steps. First, on a quarter of
   the tokens (chosen by hash): a set in which enough of these occur nowhere else can have no partner and is
   out. Then, for the sets that are left, on all tokens, which are put in order of frequency. Rare tokens
   lead, so a passage that many texts share makes no candidates.
2. and 3. By two hashes. A candidate pair that shares no token in either prefix is dropped unverified.

Before that, a pair must pass a bound on its difference: every set has ``PARITY`` bits, each the parity of
the number of its tokens with one hash, so the bits in which two sets differ cannot outnumber the tokens in
which they do. It drops nearly all pairs of a large group of texts that are alike, but not enough.

What passes is verified on the whole sets. Equal sets are one class from the start. As only components are
asked for, a posting list is first tied to its smallest member, a star; after that only pairs whose
components still differ are made, between those outside of the smallest member's component and the rest. So a
large group of near copies costs about its size, and no link between different components is missed.

Defined results: no words or a NULL text give an empty set, linked with nothing; fewer words than ``words``
give one token, the whole sequence; rows that repeat a doc_id are one document, linked if their texts differ;
rows without doc_id are in no component but their own (NULL); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.components import components
from pagewright.llm.workers import lean
from pagewright.storage import materialize

#: Odd numbers that spread products over 64 bits.
SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
PARITY = 1024
#: Ids of sets that may have a partner are broadcast up to this many rows (16 MB); more are joined by id.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Join:
    """``words`` per token, and the threshold as a percentage."""

    words: int = 4
    percent: int = 85

    def overlap(self, n):
        """Tokens that a set of n must share with any partner; for numbers, arrays and columns."""
        return (n * self.percent + 99) // 100

    def prefix(self, n):
        return n - self.overlap(n) + 1

    def difference(self, total: Column) -> Column:
        """Tokens in which two sets of so many tokens together can differ at most."""
        return total - 2 * F.ceil(total * self.percent / (100 + self.percent))

    def prefix_column(self, n: Column) -> Column:
        return n - F.floor((n * self.percent + 99) / 100) + 1


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * SPREAD[1]
    return values ^ (values >> np.uint64(32))


def tokens(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), len(found))], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    ends = len(found) - words + 1
    sums = np.zeros(ends, dtype=np.uint64)
    for i in range(words):
        sums = _mixed(sums * SPREAD[0] + hashes[i : i + ends])
    return np.unique(sums)


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(kind)))


def _sets(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n, digest of the set, and its tokens in the first quarter of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                every = [tokens(t, join.words) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([len(x) for x in every], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in every], pa.binary()),
                        _lists([x[: np.searchsorted(x, np.uint64(1 << 62))] for x in every], np.int64),
                    ],
                    names=["doc_id", "n", "digest", "sample"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, n long, digest binary, sample array<long>")


def _partnered(sets: DataFrame, join: Join) -> DataFrame:
    """The sets in which too few sampled tokens are unique to rule a partner out: doc_id, n, digest."""
    rows = sets.select("doc_id", F.explode("sample").alias("token"))
    repeated = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    shared = rows.join(repeated, "token").groupBy("doc_id").agg(F.count("*").alias("shared"))
    unique = F.size("sample") - F.coalesce("shared", F.lit(0))
    kept = sets.where("n > 0").join(shared, "doc_id", "left").where(unique < join.prefix_column(F.col("n")))
    return kept.select("doc_id", "n", "digest")


def _whole_sets(docs: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """For the wanted ids: n, all tokens, and the prefixes under the two hashed orders."""
    few = wanted.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                every = [tokens(t, join.words) for t in part["text"].to_pylist()]
                second, third, parity = [], [], []
                for x in every:
                    most = join.prefix(len(x))
                    bits = np.bincount((x & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
                    parity.append(np.packbits((bits & 1).astype(np.uint8)).view(np.int64))
                    for out, factor in ((second, SPREAD[2]), (third, SPREAD[3])):
                        order = np.sort(_mixed(x * factor))[:most]
                        out.append((order >> np.uint64(32)).astype(np.uint32))
                columns = [part["doc_id"], pa.array([len(x) for x in every], pa.int64())]
                columns += [_lists(every, np.int64), _lists(second, np.int32), _lists(third, np.int32), _lists(parity, np.int64)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "n", "tokens", "second", "third", "parity"]
    schema = "id long, n long, tokens array<long>, second array<int>, third array<int>, parity array<long>"
    return rows.mapInArrow(lean(run), schema)


def _postings(whole: DataFrame, join: Join) -> DataFrame:
    """token and ``set`` (id, n, parity): each set's prefix in the order of rarity, without tokens of one set only."""
    rows = whole.select("id", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = rows.join(counts, "token").groupBy("id").agg(F.collect_list(F.struct("df", "token")).alias("known"))
    sets = whole.select("id", "n", "parity").join(known, "id")
    # Unique tokens lead the order and make no candidates; what they leave of the prefix goes on.
    left = join.prefix_column(F.col("n")) - (F.col("n") - F.size("known"))
    rare = F.slice(F.array_sort("known"), F.lit(1), F.greatest(left, F.lit(0)).cast("int"))
    member = F.struct("id", "n", "parity").alias("set")
    return sets.select(F.explode(rare).alias("rare"), member).select("rare.token", "set")


def _linked(pairs: DataFrame, whole: DataFrame, join: Join) -> DataFrame:
    """The pairs a, b that share a token under both hashed orders and reach the threshold."""

    def side(name: str, *columns: str) -> DataFrame:
        return whole.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    orders = ("n", "second", "third")
    pairs = pairs.join(side("a", *orders), "a").join(side("b", *orders), "b")
    for order in ("second", "third"):
        pairs = pairs.where(F.arrays_overlap(f"{order}_a", f"{order}_b"))
    pairs = pairs.select("a", "b").join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - both
    return materialize(pairs.where(both * 100 >= union * join.percent).select("a", "b"))


def _near(a: Column, b: Column, join: Join) -> Column:
    """Whether sizes and parities of two sets allow the threshold."""
    sizes = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * join.percent
    differ = F.lit(0)
    for i in range(PARITY // 64):
        differ = differ + F.bit_count(F.get(a["parity"], F.lit(i)).bitwiseXOR(F.get(b["parity"], F.lit(i))))
    return sizes & (differ <= join.difference(a["n"] + b["n"]))


def _stars(postings: DataFrame, join: Join) -> DataFrame:
    """Each member of a posting list with its smallest member, where the bounds allow a link."""
    first = postings.groupBy("token").agg(F.min("set").alias("first"))
    rows = postings.join(first, "token").where(F.col("set.id") != F.col("first.id"))
    rows = rows.where(_near(F.col("set"), F.col("first"), join))
    return rows.select(F.col("first.id").alias("a"), F.col("set.id").alias("b")).distinct()


def _rest(postings: DataFrame, groups: DataFrame, join: Join) -> DataFrame:
    """Pairs of members of one posting list that are in different components as yet."""
    rows = postings.join(groups, F.col("set.id") == groups["node"], "left")
    rows = materialize(rows.select("token", "set", F.coalesce("component", "set.id").alias("part")))
    sides = rows.groupBy("token").agg(
        F.min(F.struct("set.id", "part")).alias("first"), F.min("part").alias("low"), F.max("part").alias("high")
    )
    split = sides.where("low <> high").select("token", F.col("first.part").alias("main"))
    members = rows.join(split, "token")
    apart = members.where("part <> main").select("token", F.struct("set", "part").alias("x"))
    other = members.select("token", F.struct("set", "part", "main").alias("y"))
    # Pairs of two members outside of the main component meet twice; one of the two is enough.
    once = (F.col("y.part") == F.col("y.main")) | (F.col("x.set.id") < F.col("y.set.id"))
    differ = F.col("x.part") != F.col("y.part")
    met = apart.join(
        other, (apart["token"] == other["token"]) & differ & once & _near(F.col("x.set"), F.col("y.set"), join)
    )
    ids = F.col("x.set.id"), F.col("y.set.id")
    return met.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b")).distinct()


def similar_documents(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that can be reached by links, where two documents are linked if
    100 * intersection >= percent * union of their sets.
    """
    join = Join(words, percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(_sets(docs, join))
    partnered = materialize(_partnered(sets.where(F.col("doc_id").isNotNull()), join))
    classes = partnered.groupBy("digest").agg(F.min("doc_id").alias("id"))
    copies = partnered.join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    ids = materialize(classes.select(F.col("id").alias("doc_id")).distinct())
    whole = materialize(_whole_sets(docs, ids, join))
    postings = materialize(_postings(whole, join))
    links = _linked(_stars(postings, join), whole, join)
    links = links.unionByName(_linked(_rest(postings, components(links), join), whole, join))
    groups = components(links.unionByName(copies))
    result = sets.join(groups, sets["doc_id"] == groups["node"], "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, with all their columns."""
    found = similar_documents(docs, words, percent)
    others = materialize(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
