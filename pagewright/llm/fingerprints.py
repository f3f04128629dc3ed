"""Lempel-Ziv document fingerprints.

A text is parsed into phrases as LZ78 does: each phrase is the shortest string that is not yet in the
dictionary, which then takes it in. Two texts with common passages build common phrases, so the Jaccard
similarity of their phrase sets behaves like a compression distance. The set is reduced to ``BINS`` minimum
hashes: phrases are dealt to bins by their hash, every bin keeps the smallest. The share of bins that agree,
among those filled in either text, estimates the similarity.

``neighbour_fingerprints`` also fingerprints an edited version of each text, whose tail is replaced by the
head of the next document in descending order of doc_id. Rows are dealt to ranges of doc_id with one shuffle,
the rows at the start of a range go to the range before it as well, and each range is read in order.

Defined results: a NULL text is empty; the empty text has no phrases and is like nothing but another empty
text (likeness 1); equal texts have equal fingerprints; rows without doc_id come last; rows that repeat a
doc_id are ordered by text; a single row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 128
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


class Parser:
    """The phrase dictionary of a text that is read piece by piece."""

    def __init__(self) -> None:
        self.phrases: set[str] = set()
        self.open = ""

    def read(self, text: str) -> list[str]:
        """The phrases that ``text`` adds."""
        phrases, phrase, added = self.phrases, self.open, []
        for character in text:
            phrase += character
            if phrase not in phrases:
                phrases.add(phrase)
                added.append(phrase)
                phrase = ""
        self.open = phrase
        return added

    def forget(self, added: list[str], phrase: str) -> None:
        """Go back to before ``added``, when ``phrase`` was open."""
        self.phrases.difference_update(added)
        self.open = phrase


def signature(phrases: list[str]) -> np.ndarray:
    """Smallest hash in each bin; EMPTY where a bin has no phrase."""
    made = np.full(BINS, EMPTY)
    if phrases:
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(p) for p in phrases), dtype=np.uint64, count=len(phrases))
        np.minimum.at(made, (hashes % np.uint64(BINS)).astype(np.int64), hashes // np.uint64(BINS))
    return made


def marks(minima: np.ndarray) -> np.ndarray:
    """16 bits of each minimum; 0xFFFF is kept for empty bins."""
    low = np.minimum(minima & np.uint64(0xFFFF), np.uint64(0xFFFE))
    return np.where(minima == EMPTY, np.uint64(0xFFFF), low).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two arrays of marks."""
    filled = (a != 0xFFFF) | (b != 0xFFFF)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def fingerprint(text: str | None) -> str:
    return marks(signature(Parser().read(text or ""))).tobytes().hex()


def compare(first: str, second: str) -> float:
    """Likeness of two fingerprints."""
    return likeness(*(np.frombuffer(bytes.fromhex(x), dtype=">u2") for x in (first, second)))


def both(text: str, head: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Marks of ``text``, the text with its last third replaced by ``head``, and the marks of that.

    The two share their first part, which is parsed once.
    """
    cut = len(text) - len(text) // 3
    parser = Parser()
    common = signature(parser.read(text[:cut]))
    phrase = parser.open
    added = parser.read(text[cut:])
    whole = np.minimum(common, signature(added))
    parser.forget(added, phrase)
    edited = np.minimum(common, signature(parser.read(head)))
    return marks(whole), text[:cut] + head, marks(edited)


def _dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text, range number and ``own``; each range also gets the first rows of the next one."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = docs["doc_id"].cast("long")
    steps = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = docs.agg(F.percentile_approx(key, steps, 100 * ranges).alias("b")).first()["b"]
    bounds = np.array(sorted(set(bounds or [])), dtype=np.int64)

    def range_of(ids: pd.Series) -> np.ndarray:
        known = ids.fillna(0).astype("int64").to_numpy()
        found = len(bounds) - np.searchsorted(bounds, known, side="left")
        return np.where(ids.isna(), len(bounds), found).astype("int32")

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids))

    ids = docs.select(key.alias("doc_id")).withColumn("range", place("doc_id"))
    firsts = {r["range"]: r["first"] for r in ids.groupBy("range").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    # The first rows of a range also go to the range before; those of the first range to the last one.
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        lead = (before.get(None if pd.isna(i) else int(i), -1) for i in ids)
        return pd.Series([[o] if n < 0 else [o, n] for o, n in zip(range_of(ids).tolist(), lead, strict=True)])

    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = rows.withColumn("ranges", places("doc_id")).select(
        "doc_id", "text", F.posexplode("ranges").alias("copy", "range")
    )
    return dealt.repartitionById(max(1, len(bounds) + 1), F.col("range"))


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``RESULT`` for every row of ``docs``."""
    columns = RESULT.split(", ")
    names = ["doc_id"] + [c.split()[0] for c in columns]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []  # last: doc_id and text that wait for the next row
        ready = None  # its marks, edited text's and that text, without near_next
        done = False
        for batch in batches:
            for doc_id, text, copy in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "copy")), strict=True):
                if done:
                    break
                if last is not None:
                    whole, edited, edited_marks = both(last[1], text[: len(last[1]) // 3])
                    if ready is not None:
                        out.append((*ready, likeness(ready_marks, whole)))
                    ready_marks = whole
                    ready = (
                        last[0],
                        len(last[1]),
                        hashlib.sha256(edited.encode()).hexdigest(),
                        whole.tobytes().hex(),
                        edited_marks.tobytes().hex(),
                        likeness(whole, edited_marks),
                    )
                last, done = (doc_id, text), copy > 0
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)
                out = []
        if ready is not None:
            out.append((*ready, likeness(ready_marks, marks(signature(Parser().read(last[1]))))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)

    rows = _dealt(docs).sortWithinPartitions(F.col("copy"), F.desc_nulls_last("doc_id"), F.col("text"))
    return rows.select("doc_id", "text", "copy").mapInArrow(run, f"doc_id long, {RESULT}")
