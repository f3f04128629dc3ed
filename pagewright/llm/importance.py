"""Resampling documents towards a target distribution, by hashed word features and bit-sliced sums.

Words (and runs of words) fall into buckets by a hash. The logarithm of how much more often a bucket's features
occur in the target texts than in all documents, in thousandths, is the bucket's gain; a document's weight is
the floored mean of its features' gains. Adding Gumbel noise that is drawn from a hash of the doc_id to the weight and
taking the highest sums draws documents without replacement, in proportion to the exponentials of their weights.

Weights are bit-sliced sums: a document's bucket counts become bit planes (plane j has bit j of every bucket's count), the
gains become signed planes, and the sum of count times gain over all buckets is the sum over pairs of planes of the
popcount of their AND times a power of two. It is exact.

Only sums per bucket reach the driver. Ranks come from the number of documents per score, which is bounded by the
range of scores, and from an order by doc_id among equal scores; no task sees all documents.

Defined results: a NULL text has no words; a text without features has weight 0; rows without doc_id draw the noise of the
empty id and come first among equal scores; rows that repeat are scored and ranked each; an empty target makes gains that favour
rare buckets; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.storage import materialize

BUCKETS = 10_000
ROWS = 64  # texts whose planes are made together
# A-Z in lower case; ASCII that is no letter or digit separates words.
FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def features(text: str | None, run: int = 1, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``run`` consecutive words."""
    words = (text or "").encode().translate(FOLDED).split()
    every = words if run == 1 else [b" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(zlib.crc32, every), np.uint32, len(every)) % np.uint32(buckets)


def bucket_sums(frame: DataFrame, run: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; one row per task and bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                sums += np.bincount(features(text.as_py(), run, buckets)[1], minlength=buckets)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["bucket", "n"])

    rows = frame.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    sums = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        sums[row["bucket"]] = row["n"]
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored, by bucket."""
    n = len(source)
    whole, wanted = int(source.sum()), int(target.sum())
    ratios = [float(t + 1) * float(whole + n) / (float(s + 1) * float(wanted + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def planes(values: np.ndarray) -> Iterator[np.ndarray]:
    """Bit planes of values >= 0, lowest first, 64 bits of the last axis in a word."""
    width = -values.shape[-1] % 64
    for bit in range(int(values.max(initial=0)).bit_length()):
        bits = ((values >> bit) & 1).astype(np.uint8)
        bits = np.pad(bits, [(0, 0)] * (values.ndim - 1) + [(0, width)])
        yield np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class GainPlanes:
    def __init__(self, gain: np.ndarray):
        self.signed = [(1, list(planes(np.maximum(gain, 0)))), (-1, list(planes(np.maximum(-gain, 0))))]

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """For each row of bucket counts, the sum of counts times gains."""
        total = np.zeros(len(counts), np.int64)
        for j, plane in enumerate(planes(counts)):
            live = np.flatnonzero(plane.any(axis=1))
            plane = plane[live]
            for sign, gain_planes in self.signed:
                for k, gain in enumerate(gain_planes):
                    total[live] += sign * (np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (j + k))
        return total


def weights(docs: DataFrame, gain: np.ndarray, run: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row; no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, width = GainPlanes(gain), len(gain)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                found = [features(text.as_py(), run, width) for text in part["text"]]
                counts = np.stack([np.bincount(x, minlength=width) for _, x in found])
                sizes = np.array([len(x) for _, x in found], np.int64)
                weight = np.where(sizes > 0, made.sums(counts) // np.maximum(sizes, 1), 0)
                columns = [part["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array(sizes), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: int):
    """Gumbel noise in thousandths, floored, from a hash of the doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hashed = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, run: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: int = 2024
) -> DataFrame:
    """doc_id, n_features, weight, score, and rank of the documents drawn (NULL for the others), for every row of ``docs``.

    ``percent`` of the documents with at least ``min_words`` words are drawn, those of the highest scores; ties go to the smaller doc_id.
    """
    gain = gains(bucket_sums(docs, run, buckets), bucket_sums(target, run, buckets))
    scored = materialize(weights(docs, gain, run).withColumn("score", F.col("weight") + gumbel(seed)))
    counts = scored.where(F.col("n_words") >= min_words).groupBy("score").agg(F.count("*").alias("n"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per score that occurs: the range of scores bounds it, not the number of documents.
    places = counts.select(
        F.col("score").alias("at"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"),
        F.floor(F.sum("n").over(whole) * percent / 100).alias("drawn"),
    )
    found = scored.join(places.where("above < drawn"), (F.col("score") == F.col("at")) & (F.col("n_words") >= min_words), "left")
    # Equal scores are ranked together; rows that are not in the draw stay out of the window.
    inside = found.where("at IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy("score").orderBy("doc_id")) + F.col("above")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = inside.withColumn("turn", turn).select(*columns, F.when(F.col("turn") <= F.col("drawn"), F.col("turn")).cast("long").alias("rank"))
    return found.where("at IS NULL").select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(ranked)
