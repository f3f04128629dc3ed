"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of word lists, how near their words are to words for the reader, capitals, punctuation
and disguised spellings. Besides our own lists there is a learned lexicon, as no list by hand covers every language: words
and beginnings of words that stand in toxic training documents more often than in clean ones, by more than chance explains, with
their log odds as weights. Training rows are dealt to ``FOLDS`` folds, and a row's own densities come from the lexicon of the
other folds, so the trees see lexicon hits as rare as they are in new texts.

Trees and lexicon learn from a bounded sample of the labelled rows, ``TRAINING_ROWS`` at most, taken by hash; a quarter of
them is held back from the trees and calibrates their scores, so that a score is the share of toxic rows among
rows that score alike. Every document is then scored. All work on a text is linear in its length.

Defined results: a NULL text is empty, and the empty text is scored like any other by its (zero) features;
equal texts get equal scores; labels of unknown documents, NULL labels and labels that contradict each other
for one document are not learned from; without labels of both classes for the trees, or none to calibrate with, every score
is the share of toxic labels (0 without any); rows without doc_id are scored too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.sampling import bounded_sample
from pagewright.llm.workers import lean
from pagewright.storage import materialize

# Our own word lists, lower-case, whole words.
INSULTS = (
    "idiot idiots moron morons imbecile cretin clown clowns loser losers scum trash garbage worthless pathetic disgusting "
    "stupid dumb dumbass fool jerk creep freak coward liar ugly fatso pig rat vermin filth maggot parasite lowlife "
    "retard retarded brainless useless despicable repulsive hypocrite degenerate subhuman savage "
    "idiotisch dumm dummkopf trottel arschloch abschaum versager wichser hurensohn widerlich wertlos "
    "imbécile connard connasse salaud ordure crétin débile minable dégoûtant racaille pourriture "
    "estúpido imbécil basura escoria inútil asqueroso patético perdedor payaso gilipollas cabrón"
).split()
PROFANITY = (
    "fuck fucking fucked fucker shit shitty bullshit crap damn bitch bitches bastard asshole ass dick piss cunt whore slut "
    "scheiße scheisse fick ficken verdammt putain merde bordel mierda joder puta puto coño"
).split()
THREATS = (
    "kill dead hate hang shoot burn destroy beat hurt rape strangle murder exterminate deport "
    "töten sterben hassen umbringen tuer crever mourir haïr matar morir odiar muérete"
).split()
READER = (
    "you your yours yourself you're ya u ur du dich dir dein deine euch ihr tu toi te ton ta vous votre tú te ti usted ustedes tus vosotros"
).split()
LISTS = (INSULTS, PROFANITY, THREATS, READER)
#: Signs that stand for letters in disguised spellings.
DISGUISE = str.maketrans("@4310$5!7+", "aaeiossitt")
SIGNS = frozenset("@$!+*.-_0123456789")
EDGES = ".-_!+?,;:\"'()[]{}<>"
DROPPED = str.maketrans("", "", "*.-_")
WORD = re.compile(r"[^\W\d_]+")
STRETCHED = re.compile(r"(\w)\1{2,}")
NEAR = 15  # words
WINDOW = 20  # words

FEATURES = (
    "log_words insults profanity threats reader any_listed distinct_listed log_listed near_reader nearest "
    "capitals shouted exclamations questions punctuation digits disguised disguised_listed stretched non_ascii "
    "learned strongest strongest_three distinct_learned log_learned learned_near_reader densest"
).split()
TRAINING_ROWS = 20_000
TREES, DEPTH = 30, 4
FOLDS = 5
TERMS = 2_000  # of the learned lexicon, those with the clearest evidence
EVIDENCE = 3.0  # least log odds of a term in standard errors
PREFIXES = (4, 5, 6)

Lexicon = dict[str, float]


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings with a mark that no word has."""
    return [word, *[f"{word[:n]}~" for n in PREFIXES if len(word) > n]]


class TextFeatures:
    """Features under our own lists and a learned lexicon, which gives terms their weights."""

    def __init__(self, lexicon: Lexicon | None = None) -> None:
        self.kinds: dict[str, int] = {}
        for kind, words in enumerate(LISTS):
            for word in words:
                self.kinds.setdefault(word, kind)
        self.lexicon = lexicon or {}
        self.weights: dict[str, float] = {}

    def weight(self, word: str) -> float:
        if len(self.weights) > 100_000:
            self.weights.clear()
        found = self.weights.get(word)
        if found is None:
            found = self.weights[word] = max(self.lexicon.get(t, 0.0) for t in terms_of(word))
        return found

    def of(self, text: str) -> list[float]:
        low, data = text.lower(), text.encode()
        bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        parts = text.split()
        n_words, n_chars = max(1, len(parts)), max(1, len(text))
        words = WORD.findall(low)
        known = set(words)
        kinds = {w: self.kinds[w] for w in known & self.kinds.keys()}
        learned = {w: x for w in known if (x := self.weight(w)) > 0} if self.lexicon else {}
        counts, listed, reader, taught = [0, 0, 0, 0], [], [], []
        if kinds or learned:
            for i, word in enumerate(words):
                kind = kinds.get(word)
                if kind is not None:
                    counts[kind] += 1
                    (reader if kind == 3 else listed).append(i)
                if word in learned:
                    taught.append(i)
        near, nearest = self._near(listed, reader)
        taught_near, _ = self._near(taught, reader)
        flagged = np.union1d(listed, taught)
        densest = int((np.searchsorted(flagged, flagged + WINDOW) - np.arange(len(flagged))).max()) if len(flagged) else 0
        disguised = self._disguised(low) if bytes_of[[33, 36, 42, 43, 45, 46, 64, 95, *range(48, 58)]].any() else []
        revealed = sum(self._revealed(x) for x in disguised)
        letters = max(1, int(bytes_of[65:91].sum() + bytes_of[97:123].sum()))
        punctuation = int(bytes_of[33:48].sum() + bytes_of[58:65].sum() + bytes_of[91:97].sum() + bytes_of[123:127].sum())
        best = sorted(learned.values(), reverse=True)[:3]
        return [
            math.log1p(n_words),
            *[c / n_words for c in counts],
            len(listed) / n_words,
            float(sum(k != 3 for k in kinds.values())),
            math.log1p(len(listed)),
            near / n_words,
            float(nearest),
            int(bytes_of[65:91].sum()) / letters,
            sum(1 for w in parts if len(w) > 2 and w.isupper()) / n_words if bytes_of[65:91].sum() > 2 else 0.0,
            int(bytes_of[33]) / n_chars,
            int(bytes_of[63]) / n_chars,
            punctuation / n_chars,
            int(bytes_of[48:58].sum()) / n_chars,
            len(disguised) / n_words,
            float(revealed),
            sum(1 for _ in STRETCHED.finditer(low)) / n_words,
            int(bytes_of[128:].sum()) / max(1, len(data)),
            sum(learned[words[i]] for i in taught) / n_words,
            best[0] if best else 0.0,
            sum(best),
            float(len(learned)),
            math.log1p(len(taught)),
            taught_near / n_words,
            float(densest),
        ]

    @staticmethod
    def _near(places: list[int], reader: list[int]) -> tuple[int, int]:
        """How many places have a word for the reader near them, and the least distance."""
        if not places or not reader:
            return 0, NEAR
        at, ordered = np.array(places), np.array(reader)
        right = np.searchsorted(ordered, at)
        gaps = np.minimum(
            np.abs(at - ordered[np.maximum(right - 1, 0)]), np.abs(ordered[np.minimum(right, len(ordered) - 1)] - at)
        )
        return int((gaps <= NEAR).sum()), min(NEAR, int(gaps.min()))

    @staticmethod
    def _disguised(low: str) -> list[str]:
        """Words written with signs or digits between their letters."""
        found = []
        for part in low.split():
            if part.isalpha():
                continue
            core = part.strip(EDGES)
            rest = set(core)
            signs = rest & SIGNS
            if signs and (rest - signs) and all(c.isalpha() for c in rest - signs):
                found.append(core)
        return found

    def _revealed(self, word: str) -> bool:
        """Whether a disguised spelling becomes a listed or learned word."""
        plain = word.translate(DROPPED).translate(DISGUISE)
        return self.kinds.get(plain, 3) != 3 or (bool(self.lexicon) and self.lexicon.get(plain, 0.0) > 0)


def features(docs: DataFrame, lexicons: list[Lexicon] | None = None) -> DataFrame:
    """doc_id and ``features``, an array of doubles, for every row; no shuffle.

    A column ``fold``, if there is one, says which of the lexicons a row's features use, else the last; it stays.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made_of = lexicons or [{}]
    folded = "fold" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [TextFeatures(x) for x in made_of]
        for batch in batches:
            folds = batch["fold"].to_pylist() if folded else [len(made) - 1] * len(batch)
            rows = [made[f].of(t.as_py() or "") for t, f in zip(batch["text"], folds, strict=True)]
            kept = [c for c in batch.schema.names if c != "text"]
            columns = [*[batch[c] for c in kept], pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "features"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(["fold", "label", "turn"] if folded else []))
    more = "fold int, label double, turn long, " if folded else ""
    return rows.mapInArrow(lean(run), f"doc_id {kind}, {more}features array<double>")


def lexicons(sample: DataFrame) -> list[Lexicon]:
    """For each fold the terms learned from all others, and last those learned from all; ``sample``: text, label, fold.

    Terms are counted by documents in Spark; the ``TERMS`` with the clearest evidence come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label, fold in zip(batch["text"], batch["label"], batch["fold"], strict=True):
                found = {t for w in set(WORD.findall((text.as_py() or "").lower())) for t in terms_of(w)}
                marks = [pa.array([x.as_py()] * len(found), x.type) for x in (label, fold)]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *marks], names=["term", "label", "fold"])

    sizes = {(r["label"], r["fold"]): r["count"] for r in sample.groupBy("label", "fold").count().collect()}
    words = sample.select("text", "label", "fold").mapInArrow(lean(run), "term string, label double, fold int")
    of = lambda label, fold: F.count_if((F.col("label") == label) & (F.col("fold") == fold))
    cells = [(label, fold) for label in (1.0, 0.0) for fold in range(FOLDS)]
    counts = words.groupBy("term").agg(*[of(label, fold).alias(f"n{int(label)}_{fold}") for label, fold in cells])

    def odds(toxic, clean, n_toxic, n_clean):
        """Log odds and their standard error, with half a document added everywhere."""
        return (
            F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0)),
            F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)),
        )

    kept = counts
    for left_out in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left_out]
        toxic, clean = (sum((F.col(f"n{label}_{f}") for f in folds), F.lit(0)) for label in (1, 0))
        log, error = odds(toxic, clean, *[sum(sizes.get((label, f), 0) for f in folds) for label in (1.0, 0.0)])
        kept = kept.withColumns({f"weight_{left_out}": F.when(log / error >= EVIDENCE, log).otherwise(0.0), f"clear_{left_out}": log / error})
    weights = [f"weight_{f}" for f in range(FOLDS + 1)]
    clear = F.greatest(*[f"clear_{f}" for f in range(FOLDS + 1)])
    rows = kept.where(sum((F.col(w) for w in weights), F.lit(0.0)) > 0).orderBy(F.desc(clear), "term").limit(TERMS).collect()
    return [{r["term"]: r[w] for r in rows if r[w] > 0} for w in weights]


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string")) % by


def scored(docs: DataFrame, labels: DataFrame, held_out: int = 5, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    Labels (doc_id, toxic) are learned only from documents whose crc32 of the id modulo ``held_out`` is not 0.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    toxic = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    toxic = toxic.where("toxic = other AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("double").alias("label"))
    # A bounded sample is enough for trees of this size; everything else sees all rows. Ids meet first, then the texts of the sample.
    learning = toxic.where(remainder(F.col("doc_id"), held_out) != 0).join(texts.select("doc_id"), "doc_id", "left_semi")
    drawn = materialize(bounded_sample(materialize(learning), training_rows, "doc_id"))
    fold = F.pmod(F.shiftright("turn", 10), F.lit(FOLDS)).cast("int")
    sample = materialize(texts.join(F.broadcast(drawn), "doc_id").withColumn("fold", fold).repartition(4 * FOLDS, "turn"))
    calibrating = F.pmod(F.shiftright("turn", 20), F.lit(4)) == 0
    sizes = {(r["label"], r["aside"]): r["count"] for r in sample.groupBy("label", calibrating.alias("aside")).count().collect()}
    flag = F.coalesce(remainder(F.col("doc_id"), held_out) == 0, F.lit(False))
    if len({label for label, aside in sizes if not aside}) < 2 or not any(aside for _, aside in sizes):
        share = sum(n for (label, _), n in sizes.items() if label == 1) / max(1, sum(sizes.values()))
        out, score = texts.select("doc_id", flag.alias("held_out")), F.lit(float(share))
    else:
        learned = lexicons(sample)
        known = materialize(features(sample, learned)).select("label", "turn", array_to_vector("features").alias("vector"))
        trees = GBTClassifier(
            featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.15, subsamplingRate=0.8, seed=7
        ).fit(known.where(~calibrating))
        raw = vector_to_array("probability")[1]
        ranked = trees.transform(known.where(calibrating)).select("label", raw.alias("raw"))
        isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(ranked)
        out = materialize(features(texts, learned[-1:])).withColumn("held_out", flag)
        out = trees.transform(out.withColumn("vector", array_to_vector("features"))).withColumn("raw", raw)
        out = isotonic.transform(out)
        # A pool without exceptions does not make certainty.
        score = F.least(F.greatest(F.col("calibrated"), F.lit(0.001)), F.lit(0.999))
    out = out.withColumn("score", score)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    toxic = materialize(scored(docs, labels).where("predicted = 1").select("doc_id").distinct())
    return docs.join(toxic, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
