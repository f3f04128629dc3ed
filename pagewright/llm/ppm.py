"""Language-model scores by prediction by partial matching (PPM, escape method D, with symbol exclusion).

The model predicts a document's normal form (words in lower case with single spaces between, then an end
symbol) byte by byte from the ``ORDER`` bytes before. A context that has not seen the byte escapes to the
next shorter one: each distinct byte gives up half of one count to the escape. Bytes that the longer context
has seen are excluded from the shorter one's counts. Below the empty context all bytes are equal.

All documents' (ORDER + 1)-grams are counted in one aggregate, with how often each occurs in training documents;
shorter contexts are sums of longer ones. Spark tables, one for each order, hold all of them, and from order to
order each distinct gram gets its log probability by a join with its own end, one byte shorter, of which there are 256
grams at most. Nothing is left out, however many grams there are. The ``MOST_GRAMS`` most frequent grams go to every
task with their log probabilities (16 bytes each), which leaves no hot gram for the join that brings those of all others.

Besides, every text gets the score of smoothed word frequencies. The frequent words, ``HEAD_WORDS`` at most,
go to every task in the same way.

Defined results: a NULL text is empty; the empty text is its end symbol alone; rows that repeat are scored
each; rows without doc_id are held out; without training documents bytes are equal and no word is known; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.storage import materialize

ORDER = 5
START, FINISH = 0xFE, 0xFF  # bytes that no UTF-8 text has
SYMBOLS = 256
MOST_GRAMS = 1_000_000
HEAD_WORDS = 200_000
END_WORD = 0  # stands for the end token among word hashes
PART = 256 << 10  # characters scored at a time
COUNTED = 4 << 20  # characters counted at a time


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All (ORDER + 1)-grams of the texts, each with starts before and an end behind, and where each begins."""
    pad = bytes([START]) * ORDER
    joined = np.frombuffer(b"".join(pad + t + bytes([FINISH]) for t in texts), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(t) + 1 for t in texts])
    made = np.zeros(max(0, len(joined) - ORDER), dtype=np.uint64)
    for i in range(ORDER + 1):
        made = (made << np.uint64(8)) | joined[i : len(joined) - ORDER + i]
    # Grams that end inside the starts of the next text are none.
    keep = np.ones(len(made), dtype=bool)
    ends = np.cumsum(lengths + ORDER)[:-1]
    if len(ends):
        keep[(ends[:, None] - ORDER + np.arange(ORDER)).ravel()] = False
    return made[keep], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _parts(texts: pa.Array, size: int) -> Iterator[list[list[bytes]]]:
    """The words of each text, for about ``size`` characters of texts at a time."""
    part, total = [], 0
    for item in texts:
        text = item.as_py() or ""
        part.append(words_of(text))
        total += len(text)
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def _counts(docs: DataFrame) -> DataFrame:
    """kind ("gram" or "word"), key, n in the rows of ``docs`` that train, and m in all rows; words of those that train."""

    def counted(kind: str, keys: np.ndarray, counts: np.ndarray, trains: bool) -> pa.RecordBatch:
        columns = [pa.array([kind] * len(keys)), pa.array(keys), pa.array(counts * trains), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trains in (True, False):
                for part in _parts(batch.filter(pc.equal(batch["trains"], trains))["text"], COUNTED):
                    found, counts = np.unique(grams_of([b" ".join(w) for w in part])[0], return_counts=True)
                    yield counted("gram", found.view(np.int64), counts, trains)
                    if trains:
                        found, counts = np.unique(word_hashes([w for words in part for w in words]), return_counts=True)
                        yield counted("word", np.append(found, END_WORD), np.append(counts, len(part)), trains)

    parts = docs.select("text", "trains").mapInArrow(run, "kind string, key long, n long, m long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """key, m and log10 of the probability of the last byte after those before, for all counted grams (key, n, m).

    Grams with n = 0 were not seen in training. Order by order, ``whole`` is the logarithm for a byte that no
    longer context has seen, and ``after`` the one for a byte that this context has escaped from.
    """
    orders = [grams]
    for k in range(ORDER - 1, -1, -1):
        end = F.col("key").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("key")
        orders.insert(0, materialize(orders[0].groupBy(end).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))))
    below = None
    n, total, distinct = (F.col(c).cast("double") for c in ("n", "total", "distinct"))
    for k, rows in enumerate(orders):
        context = Window.partitionBy(F.shiftright("key", 8))
        sums = {"total": F.sum("n").over(context), "distinct": F.count_if(F.col("n") > 0).over(context)}
        if below is None:
            rows = rows.withColumns(sums)
            after = -F.log10(F.greatest(F.lit(1), SYMBOLS - F.col("distinct")).cast("double"))
            none = F.lit(-math.log10(SYMBOLS))
        else:
            short = below.select(F.col("key").alias("short"), *[F.col(c).alias(f"short_{c}") for c in ("n", "total", "distinct", "whole", "after")])
            rows = rows.join(short, F.col("key").bitwiseAND((1 << (8 * k)) - 1) == F.col("short"))
            # What is left of the next shorter context once this context's own bytes are excluded.
            sums["used"] = F.sum(F.when(F.col("n") > 0, F.col("short_n")).otherwise(0)).over(context)
            rows = rows.withColumns(sums)
            room = F.greatest(F.lit(1), F.col("short_total") - F.col("used")).cast("double")
            left = (F.col("short_distinct") - F.col("distinct")).cast("double")
            # A context with nothing left to code escapes for sure.
            escape = F.when(left > 0, F.log10(0.5 * left / room)).otherwise(F.lit(0.0)) + F.col("short_after")
            after = F.when(F.col("short_n") > 0, F.log10((F.col("short_n") - 0.5) / room)).otherwise(escape)
            none = F.col("short_whole")
        rows = rows.withColumn("after", after)
        whole = F.when(n > 0, F.log10((n - 0.5) / total)).when(total > 0, F.log10(0.5 * distinct / total) + F.col("after"))
        below = rows.select("key", "n", "m", "total", "distinct", "after", whole.otherwise(none).alias("whole"))
    return below.select("key", "m", F.col("whole").alias("log"))


class Lookup:
    """Hash table from 64-bit keys to doubles, none of them NaN, for whole arrays; each key is in one of ``probes`` slots."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, (2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.full(1 << self.bits, np.nan)  # NaN where nothing is
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            slots = self._slots(keys[todo], self.probes)
            free = np.isnan(self.values[slots])
            # Of several keys for a free slot the last one gets it.
            self.keys[slots[free]] = keys[todo[free]]
            got = free & (self.keys[slots] == keys[todo])
            self.values[slots[got]] = values[todo[got]]
            todo, self.probes = todo[~got], self.probes + 1

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        # The added number moves every key from probe to probe, also 0, which no factor moves.
        factor = np.uint64((0x9E3779B97F4A7C15 + 2 * probe * 0x51ED270B7A3F4C15) & 0xFFFFFFFFFFFFFFFF | 1)
        mixed = (keys + np.uint64(probe * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * factor
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 without), and which keys are in the table."""
        values, found = np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            slots = self._slots(keys[todo], probe)
            held = self.values[slots]
            hit = (self.keys[slots] == keys[todo]) & ~np.isnan(held)
            values[todo[hit]], found[todo[hit]] = held[hit], True
            todo = todo[~hit]
            if not len(todo):
                break
        return values, found


def _threshold(counts: DataFrame, most: int, n: str = "n") -> int:
    """The smallest count ``n`` that at most ``most`` rows reach."""
    sizes = counts.groupBy(F.least(n, F.lit(100_000)).alias("n")).agg(F.count("*").alias("rows"))
    total = 0
    for row in sorted(sizes.collect(), reverse=True):
        total += row["rows"]
        if total > most:
            return row["n"] + 1
    return 1


def held_out(doc_id: Column, by: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % by == 0, F.lit(True))


def score(docs: DataFrame, by: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Documents whose crc32 of the id modulo ``by`` is not 0 train the model. ``score`` is the model's log10
    probability of the text, ``base_score`` that of smoothed word frequencies.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = materialize(_counts(docs.withColumn("trains", ~held_out(F.col("doc_id"), by))))
    words = counts.where("kind = 'word'").select("key", "n")
    grams = materialize(log_probabilities(counts.where("kind = 'gram'").select("key", "n", "m")))
    often = F.col("m") >= _threshold(grams, MOST_GRAMS, "m")
    top = grams.where(often).toArrow()
    likely = spark.sparkContext.broadcast((top["key"].to_numpy().view(np.uint64), top["log"].to_numpy()))
    all_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = _threshold(words, HEAD_WORDS)
    head_rows = words.where(F.col("n") >= least).toArrow()
    head = spark.sparkContext.broadcast((head_rows["key"].to_numpy().view(np.uint64), head_rows["n"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(*likely.value)
        frequent = Lookup(head.value[0], head.value[1].astype(np.float64))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for part in _parts(batch["text"], PART):
                grams, begins = grams_of([b" ".join(w) for w in part])
                logs, found = known.get(grams)
                others = np.concatenate([[0], np.cumsum(~found)])
                ends = np.append(others[begins], others[-1]).astype(np.int32)
                lengths = np.array([len(w) for w in part])
                hashes = word_hashes([w for words in part for w in words]).view(np.uint64)
                # The end token goes first in each row, so that no row is empty.
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                hashes = np.insert(hashes, starts, np.uint64(END_WORD))
                starts = starts + np.arange(len(part))
                n, common = frequent.get(hashes)
                sums = np.add.reduceat(np.where(common, np.log10(n + 0.1), 0.0), starts)
                hits = np.add.reduceat(common.astype(np.int64), starts)
                tails = np.concatenate([[0], np.cumsum(~common)])
                offsets = np.append(tails[starts], tails[-1]).astype(np.int32)
                columns = [
                    batch["doc_id"].slice(done, len(part)),
                    pa.array(row + np.arange(len(part))),
                    pa.array(lengths + 1),
                    pa.array(hits),
                    pa.array(sums),
                    pa.array(np.add.reduceat(logs, begins)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[~found].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[~common].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done, row = done + len(part), row + len(part)

    names = ["doc_id", "row", "n_tokens", "head_known", "head_sum", "head_score", "rare", "tail"]
    schema = (
        f"doc_id {kind}, row long, n_tokens long, head_known long, head_sum double, head_score double, "
        "rare array<long>, tail array<long>"
    )
    rows = materialize(docs.mapInArrow(run, schema))
    rare = rows.select("row", F.explode("rare").alias("key")).join(grams.where(~often), "key")
    rare = rare.groupBy("row").agg(F.sum("log").alias("log"))
    tail = rows.select("row", F.explode("tail").alias("key")).join(words, "key", "left")
    tail = tail.groupBy("row").agg(
        F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("sum")
    )
    room = math.log10(all_words["n"] + 0.1 * (all_words["v"] + 1))
    zero = F.lit(0)
    return rows.join(tail, "row", "left").join(rare, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), by).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(all_words["n"]).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * room).alias("base_score"),
        (F.col("head_score") + F.coalesce("log", F.lit(0.0))).alias("score"),
    )
