"""Reversible line deduplication: exact reference counts, with sharded cuckoo filters in front of them.

A line's key is its normal form (ASCII white space stripped at both ends, A-Z lower-cased); tables hold the
16-byte digest of it. ``LineIndex`` keeps, for every key, the exact number of documents it occurs in. Adding
documents adds their counts, deleting documents subtracts them, so a document can be taken back at any time
and the index is as if it had never been there. Every version is a written table; nothing is changed in place.

Common keys (in at least ``min_docs`` documents) also go into one cuckoo filter per shard of the key space. A change
of the index puts only those keys into their shard's filter, or takes them out of it, whose count crosses ``min_docs``; a filter
that gets too full is made anew, larger, from the counts. To clean documents, each distinct key is sent to its shard, whose filter
stands before it in the same sorted partition and answers "surely not common" for nearly all; only the rest is joined with the exact
counts, which decide alone. Tasks hold one filter at a time, at any size of the index.

Defined results: a NULL or empty text is one empty line, which has no key; keys below ``min_chars`` code
points are never dropped; rows that repeat a doc_id count as one document, and each of them is cleaned;
rows without doc_id are cleaned but are no document of the index; an empty table gives no rows. All work on a document is
linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.workers import lean
from pagewright.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 500
FULL = 0.93  # load of a filter that is made anew


def normal_form(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(normal_form(line)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class CuckooFilter:
    """Approximate set of 64-bit hashes that supports deletion; never forgets an element it holds.

    Every element has a 16-bit mark and two buckets of ``SLOTS`` slots; the second bucket follows from the
    first and the mark alone, so marks can be moved without their elements. Marks that find no slot after
    ``KICKS`` moves are kept in a list beside the buckets.
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.rest: list[tuple[int, int]] = []

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        need = max(1, int(len(hashes) / (0.85 * SLOTS)) + 1)
        made = cls(1 << (need - 1).bit_length())
        for value in hashes.tolist():
            made.insert(value)
        return made

    @property
    def mask(self) -> int:
        return len(self.table) - 1

    def _place(self, value: int) -> tuple[int, int]:
        value &= 0xFFFFFFFFFFFFFFFF
        return (value >> 16) & self.mask, (value & 0xFFFF) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def insert(self, value: int) -> None:
        bucket, mark = self._place(value)
        for place in (bucket, self._other(bucket, mark)):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return
        self.rest.append((bucket, mark))

    def delete(self, value: int) -> None:
        """Take out one element that was inserted."""
        bucket, mark = self._place(value)
        for place in (bucket, self._other(bucket, mark)):
            if (place, mark) in self.rest:
                self.rest.remove((place, mark))
                return
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """For an array of 64-bit hashes, whether each may be in the set."""
        values = hashes.astype(np.uint64)
        marks = (values & np.uint64(0xFFFF)).astype(np.uint16)
        marks[marks == 0] = 1
        first = ((values >> np.uint64(16)) & np.uint64(self.mask)).astype(np.int64)
        second = (first ^ (marks.astype(np.int64) * 0x5BD1E995)) & self.mask
        found = (self.table[first] == marks[:, None]).any(1) | (self.table[second] == marks[:, None]).any(1)
        for bucket, mark in self.rest:
            found |= (marks == mark) & ((first == bucket) | (second == bucket))
        return found

    @property
    def load(self) -> float:
        return (np.count_nonzero(self.table) + len(self.rest)) / self.table.size

    def to_bytes(self) -> bytes:
        rest = np.array(self.rest, dtype=np.int64).reshape(-1, 2)
        return np.array([len(self.table)], dtype=np.int64).tobytes() + self.table.tobytes() + rest.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets = int(np.frombuffer(data, np.int64, 1)[0])
        end = 8 + buckets * SLOTS * 2
        made = cls(1)
        made.table = np.frombuffer(data[8:end], np.uint16).reshape(buckets, SLOTS).copy()
        made.rest = [tuple(x) for x in np.frombuffer(data[end:], np.int64).reshape(-1, 2).tolist()]
        return made


def _runs(shards: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of equal values."""
    cuts = np.flatnonzero(np.diff(shards)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that the filter of their shard, which comes before them, cannot rule out."""
    shard, cuckoo = None, None
    for batch in batches:
        shards, kinds = batch["shard"].to_numpy(), batch["kind"].to_numpy()
        may = np.zeros(len(shards), dtype=bool)
        for start, end in _runs(shards) if len(shards) else ():
            if shards[start] != shard:
                shard, cuckoo = shards[start], None
            if kinds[start] == 0:
                cuckoo, start = CuckooFilter.from_bytes(batch["data"][start].as_py()), start + 1
            if cuckoo is not None and start < end:
                hashes = batch["hash"].slice(start, end - start).to_numpy()
                may[start:end] = cuckoo.contains(hashes)
        yield batch.select(["key"]).filter(pa.array(may))


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's filter with its changes made in place; ``full`` if it should be made anew."""

    def told() -> pa.RecordBatch:
        full = cuckoo.load > FULL or bool(cuckoo.rest)
        columns = [pa.array([shard], pa.int64()), pa.array([cuckoo.to_bytes()], pa.binary()), pa.array([full])]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "data", "full"])

    shard, cuckoo = None, None
    for batch in batches:
        shards = batch["shard"].to_numpy()
        for start, end in _runs(shards) if len(shards) else ():
            if shards[start] != shard:
                if cuckoo is not None:
                    yield told()
                shard, cuckoo = int(shards[start]), CuckooFilter(1)
            if batch["kind"][start].as_py() == 0:
                cuckoo, start = CuckooFilter.from_bytes(batch["data"][start].as_py()), start + 1
            changes = zip(batch["hash"].slice(start, end - start), batch["change"].slice(start, end - start), strict=True)
            for value, change in changes:
                (cuckoo.insert if change.as_py() > 0 else cuckoo.delete)(value.as_py())
    if cuckoo is not None:
        yield told()


@dataclass(frozen=True)
class LineIndex:
    """A version of the index. ``refs``: key, n_docs; ``filters``: shard, data."""

    refs: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int = 64
    min_docs: int = 10
    min_chars: int = 1
    shard_keys: int = 1_000_000

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents, which must not be in it yet."""
        return self.changed(self.keys(docs), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without these documents, which must be in it with the same texts."""
        return self.changed(self.keys(docs), -1)

    def clean(self, docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """Every row of ``docs`` as ``doc``, a struct, with the digests of its common lines as ``common``.

        ``keys`` are those of ``docs``, if they are known.
        """
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
        keys = self.keys(docs) if keys is None else keys
        common = self._screened(keys.select("key").distinct()).join(self.refs.where(F.col("n_docs") >= self.min_docs), "key")
        # One row per document and key on the left, one per key on the right: skew is on the left only,
        # where the adaptive join can split it.
        hits = keys.join(common.select("key"), "key").groupBy("doc_id").agg(F.collect_list("key").alias("common"))
        joined = rows.join(hits, F.col("doc.doc_id").eqNullSafe(hits["doc_id"]), "left")
        return joined.select("doc", F.coalesce("common", F.array().cast("array<binary>")).alias("common"))

    def keys(self, docs: DataFrame) -> DataFrame:
        """Distinct doc_id and key of all lines that have a key."""
        long_enough = F.filter(_lines(F.col("text")), lambda x: F.length(normal_form(x)) >= self.min_chars)
        # Repeats go in the aggregate: distinct binary values of one array would be found by comparing them all.
        return docs.select("doc_id", F.explode(F.transform(long_enough, _digest)).alias("key")).dropDuplicates()

    def changed(self, keys: DataFrame, sign: int) -> LineIndex:
        """The index with the ``keys`` of documents added (1) or taken out (-1)."""
        counts = keys.where(F.col("doc_id").isNotNull()).groupBy("key").agg((F.count("*") * sign).alias("n_docs"))
        if self.refs is None:
            refs = materialize(counts.where("n_docs <> 0"))
            common = refs.where(F.col("n_docs") >= self.min_docs)
            made = replace(self, refs=refs, shards=max(self.shards, -(-common.count() // self.shard_keys)))
            return replace(made, filters=materialize(made._built(common)))
        zero = F.lit(0).cast("long")
        both = self.refs.select("key", F.col("n_docs").alias("old"), zero.alias("change")).unionByName(
            counts.select("key", zero.alias("old"), F.col("n_docs").alias("change"))
        )
        both = materialize(both.groupBy("key").agg(F.sum("old").alias("old"), (F.sum("old") + F.sum("change")).alias("n_docs")))
        refs = both.where("n_docs <> 0").select("key", "n_docs")
        was, now = F.col("old") >= self.min_docs, F.col("n_docs") >= self.min_docs
        crossing = both.where(was != now).select("key", F.when(now, 1).otherwise(-1).alias("change"))
        updated = materialize(self._beside_filters(crossing).mapInArrow(lean(_update), "shard long, data binary, full boolean"))
        made = replace(self, refs=refs)
        again = updated.where("full").select("shard")
        rebuilt = made._built(refs.where(F.col("n_docs") >= self.min_docs), again)
        return replace(made, filters=materialize(updated.where("NOT full").select("shard", "data").unionByName(rebuilt)))

    def _sharded(self, keys: DataFrame) -> DataFrame:
        hashed = keys.withColumn("hash", F.xxhash64("key"))
        return hashed.withColumn("shard", F.pmod(F.shiftrightunsigned("hash", 48), F.lit(self.shards)).cast("long"))

    def _built(self, common: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """New filters of the common keys, of all shards or of some; each holds about ``shard_keys`` keys at most when the index begins."""

        def build(group: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.of(np.sort(group["hash"].to_numpy()))
            return pd.DataFrame({"shard": [group["shard"].iloc[0]], "data": [made.to_bytes()]})

        sharded = self._sharded(common.select("key"))
        if only is not None:
            sharded = sharded.join(F.broadcast(only), "shard", "left_semi")  # ``shards`` rows at most
        return sharded.select("shard", "hash").groupBy("shard").applyInPandas(build, "shard long, data binary")

    def _beside_filters(self, keys: DataFrame) -> DataFrame:
        """The filter of each shard and behind it the shard's keys (key and, to update, change), sorted in partitions."""
        change = F.col("change").cast("int") if "change" in keys.columns else F.lit(1)
        rows = self._sharded(keys).select(
            "shard", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("data"), "key", "hash", change.alias("change")
        )
        stored = self.filters.select(
            "shard", F.lit(0).alias("kind"), "data", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("change")
        )
        return stored.unionByName(rows).repartition("shard").sortWithinPartitions("shard", "kind")

    def _screened(self, keys: DataFrame) -> DataFrame:
        """The distinct ``keys`` that the filters cannot rule out."""
        return self._beside_filters(keys).mapInArrow(lean(_screen), "key binary")


@F.pandas_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_dropped", T.LongType())]))
def _without(texts: pd.Series, common: pd.Series) -> pd.DataFrame:
    """Texts without the lines whose digests are listed; one pass over each text."""
    kept, dropped = [], []
    for text, digests in zip(texts, common, strict=True):
        if text is None or not len(digests):
            kept.append(None)
            dropped.append(0)
            continue
        gone, lines = set(digests), text.encode().split(b"\n")
        stays = [x for x in lines if md5(x.strip(b" \t\n\x0b\x0c\r").lower()).digest() not in gone]
        kept.append(b"\n".join(stays).decode())
        dropped.append(len(lines) - len(stays))
    return pd.DataFrame({"kept": kept, "n_dropped": dropped})


def kept_text(cleaned: DataFrame) -> DataFrame:
    """From ``LineIndex.clean``: doc, n_lines, n_dropped and the text that stays, as ``kept``.

    Only texts with common lines leave the JVM.
    """
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    cut = cleaned.withColumn("cut", _without(F.when(F.size("common") > 0, text), F.col("common")))
    n_breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return cut.select(
        "doc",
        (n_breaks + 1).cast("long").alias("n_lines"),
        F.col("cut.n_dropped").alias("n_dropped"),
        F.when(F.size("common") > 0, F.col("cut.kept")).otherwise(text).alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All documents without the lines that at least ``min_docs`` of them share; columns as ``kept_text``."""
    index = LineIndex(min_docs=min_docs, min_chars=min_chars)
    keys = materialize(index.keys(docs))
    return kept_text(index.changed(keys, 1).clean(docs, keys))
