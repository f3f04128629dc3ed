"""Quality rules under weak supervision.

Every rule looks at a few statistics of a text and votes 1 (good), 0 (bad) or abstains (NULL).
Expectation-maximisation over the votes of the whole corpus estimates how often each rule is right, without
labels; a text is kept if its posterior probability of being good reaches the threshold. All of it is
DataFrame expressions: statistics inside the row, one small aggregate of vote patterns, and one aggregate
of that pattern table for each iteration.

Defined results: a NULL text counts as empty; a text without words has zero statistics and fails the base
rule; equal texts get equal verdicts; repeated rows stay repeated and all count; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.binding import let
from pagewright.storage import materialize

WINDOW = 8  # a power of two
SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``value`` is outside of bad_low..bad_high, good inside of good_low..good_high.

    ``where`` names the texts the rule can judge; elsewhere, and between the limits, it abstains.
    """

    name: str
    value: str
    good: tuple[float, float]
    bad: tuple[float, float]
    where: str = "n_words >= 20"

    def vote(self) -> Column:
        where = F.expr(self.where)
        # Not even a shared subexpression divides where the rule abstains.
        value = F.when(where, F.expr(self.value))
        return F.when(where & value.between(*self.good), F.lit(1)).when(
            where & ~value.between(*self.bad), F.lit(0)
        )


INF = float("inf")
PRIOR = (0.05, 0.95)
# Narrow limits on purpose: a rule may err often and overlap with others, as no single vote decides.
RULES = (
    Rule("length", "cast(n_words as double)", (100, INF), (40, INF), "true"),
    Rule("symbols", "n_symbols / word_chars", (0, 0.005), (0, 0.03)),
    Rule("symbol_words", "n_symbols / n_words", (0, 0.02), (0, 0.1)),
    Rule("word_length", "word_chars / n_words", (3.5, 8), (3, 10)),
    Rule("short_words", "n_short / n_words", (0.15, 0.55), (0.05, 0.7)),
    Rule("duplicate_lines", "n_dup_lines / n_lines", (0, 0.05), (0, 0.2), "n_words >= 20 and n_lines >= 3"),
    Rule("repeated_windows", "n_repeat_words / n_words", (0, 0.05), (0, 0.15)),
    Rule("distinct_words", "n_distinct / n_words", (0.5, 1), (0.35, 1), "n_words between 20 and 1000"),
    Rule("capitals", "n_upper / word_chars", (0, 0.08), (0, 0.2)),
    Rule("letters", "n_letters / word_chars", (0.93, 1), (0.85, 1)),
    Rule("mostly_letters", "n_letters / word_chars", (0.96, 1), (0.93, 1)),
    Rule("wordless", "n_wordless / n_words", (0, 0.01), (0, 0.05)),
    Rule("digits", "n_digits / word_chars", (0, 0.03), (0, 0.1)),
    Rule("sentence_ends", "n_ends / n_lines", (0.6, 1), (0.2, 1)),
    Rule("sentence_length", "n_words / (n_sentences + 1)", (4, 40), (2, 80)),
)


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed != "", F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))


def _paired(hashes: Column, distance: int) -> Column:
    """At each place, one hash of the hashes at this place and ``distance`` places on."""
    return F.zip_with(
        hashes, F.slice(hashes, distance + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b)
    )


def _covered(grams: Column) -> Column:
    """Number of words inside windows whose hash occurs at least twice in ``grams``.

    Sorting brings equal windows together, a second sort gives the starts in order; each start covers at
    most the distance to the one before it. Linear but for the two sorts, whatever repeats how often.
    """
    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, j: F.get(s, j)["h"].eqNullSafe(x["h"])
        repeated = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.array_sort(F.transform(repeated, lambda x: x["i"]))

    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(
        let(pairs, starts),
        zero,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
    )["n"]
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), total).otherwise(F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics the rules use; one row per input row, no shuffle."""
    text = F.col("text")
    frame = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    frame = frame.withColumns(
        {"words": words(text), "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))}
    )
    # Runs of 1, 2, 4, 8 words: each step hashes two neighbours of the step before.
    frame = frame.withColumn("runs", F.transform("words", lambda w: F.xxhash64(w)))
    for distance in (1, 2, 4):
        frame = frame.withColumn("runs", _paired(F.col("runs"), distance))
    whole = F.slice("runs", 1, F.greatest(F.size("runs") - (WINDOW - 1), F.lit(0)))
    frame = frame.withColumn("grams", whole)
    count = lambda c: c.cast("long")
    return frame.select(
        "doc_id",
        count(F.size("words")).alias("n_words"),
        count(F.length(F.array_join("words", ""))).alias("word_chars"),
        count(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        count(_covered(F.col("grams"))).alias("n_repeat_words"),
        count(F.size("lines")).alias("n_lines"),
        count(F.size(F.array_distinct("words"))).alias("n_distinct"),
        count(F.size(F.filter("words", lambda w: F.length(w) <= 3))).alias("n_short"),
        count(F.regexp_count("text", F.lit(r"[.!?][\x20\x09-\x0D]"))).alias("n_sentences"),
        count(F.regexp_count("text", F.lit(r"\p{L}"))).alias("n_letters"),
        count(F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]++(?![^\x20\x09-\x0D])"))).alias("n_wordless"),
        count(F.regexp_count("text", F.lit(r"\p{Lu}"))).alias("n_upper"),
        count(F.regexp_count("text", F.lit(r"[0-9]"))).alias("n_digits"),
        count(F.size(F.filter("lines", lambda x: x.rlike(r"[.!?\"'”»…:;]\s*$")))).alias("n_ends"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


@dataclass(frozen=True)
class Accuracy:
    """How often a rule that votes is right: on good texts, and on bad ones."""

    good: float
    bad: float

    # Wide limits, which only keep probabilities away from 0 and 1.
    GOOD = (0.5, 0.9999)
    BAD = (0.02, 0.98)
    #: A bad vote is at least so many times as likely on bad texts as on good ones, so the classes cannot change places.
    ANCHOR = 1.2


def posterior(rules: tuple[Rule, ...], prior: float, accuracies: dict[str, Accuracy]) -> Column:
    """Probability of a good text given its votes, if rules err independently."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for rule in rules:
        a, vote = accuracies[rule.name], F.col(f"vote_{rule.name}")
        for_good, for_bad = math.log(a.good / (1 - a.bad)), math.log((1 - a.good) / a.bad)
        odds = odds + F.coalesce(F.when(vote == 1, for_good).when(vote == 0, for_bad), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def _clamp(value: Column, limits: tuple[float, float]) -> Column:
    return F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), value))


def _total(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, item: total + value(item))


def _iteration(patterns: Column, state: Column) -> Column:
    """One step over the array of vote patterns; state: prior, and both accuracies by rule."""
    weights = F.zip_with(
        state["good"],
        state["bad"],
        lambda g, b: F.struct(F.log((1 - g) / b).alias("no"), F.log(g / (1 - b)).alias("yes")),
    )

    def counted(weights: Column) -> Column:
        def share(p: Column) -> Column:
            by_rule = F.zip_with(
                p["votes"], weights, lambda v, w: F.when(v == 1, w["yes"]).when(v == 0, w["no"]).otherwise(0.0)
            )
            odds = F.log(state["prior"] / (1 - state["prior"])) + _total(by_rule, lambda x: x)
            return p["n"] / (1 + F.exp(-odds))

        return F.transform(
            patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), share(p).alias("good"))
        )

    def updated(items: Column) -> Column:
        def by_rule(old: Column, part: Callable[[Column], Column], right: int, limits) -> Column:
            def rate(before: Column, rule: Column) -> Column:
                vote = lambda x: F.get(x["votes"], rule)
                hits = _total(items, lambda x: F.when(vote(x) == right, part(x)).otherwise(0.0))
                votes = _total(items, lambda x: F.when(vote(x) >= 0, part(x)).otherwise(0.0))
                # One text that agrees with the value so far stands in for rules that never vote.
                return _clamp((hits + before) / (votes + 1), limits)

            return F.transform(old, rate)

        rows, good = _total(items, lambda x: x["n"]), _total(items, lambda x: x["good"])
        return F.struct(
            F.when(rows > 0, _clamp(good / rows, PRIOR)).otherwise(state["prior"]).alias("prior"),
            by_rule(state["good"], lambda x: x["good"], 1, Accuracy.GOOD).alias("good"),
            by_rule(state["bad"], lambda x: x["n"] - x["good"], 0, Accuracy.BAD).alias("bad"),
        )

    def anchored(state: Column) -> Column:
        least = lambda good: F.least(F.lit(Accuracy.BAD[1]), (1 - good) * Accuracy.ANCHOR)
        return state.withField("bad", F.zip_with(state["good"], state["bad"], lambda g, b: F.greatest(b, least(g))))

    return let(let(let(weights, counted), updated), anchored)


def estimate(
    votes: DataFrame, rules: tuple[Rule, ...] = RULES, iterations: int = 30
) -> tuple[float, dict[str, Accuracy]]:
    """Share of good texts and accuracies of each rule by expectation-maximisation over all rows of ``votes``.

    Rows are first counted by vote pattern. How many patterns there are depends on the rules, not on the size of the corpus (the rules here: some
    hundreds), so all iterations run as one expression over the array of them.
    """
    array = F.array(*[F.coalesce(F.col(f"vote_{r.name}"), F.lit(-1)) for r in rules])
    counts = votes.groupBy(array.alias("votes")).agg(F.count("*").cast("double").alias("n"))
    patterns = counts.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    repeat = lambda x: F.array_repeat(F.lit(x), len(rules))
    start = F.struct(F.lit(0.8).alias("prior"), repeat(0.95).alias("good"), repeat(0.4).alias("bad"))
    steps = F.sequence(F.lit(1), F.lit(iterations))
    end = F.aggregate(steps, start, lambda state, _: _iteration(F.col("patterns"), state))
    row = patterns.select(end.alias("end")).first()["end"]
    return row["prior"], {r.name: Accuracy(g, b) for r, g, b in zip(rules, row["good"], row["bad"], strict=True)}


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, posterior and verdict of every row.

    ``kept`` is false where the base rule fails, else posterior >= threshold.
    """
    measured = materialize(statistics(docs))
    voted = measured.withColumns({f"vote_{r.name}": r.vote() for r in rules})
    prior, accuracies = estimate(voted, rules)
    return voted.withColumn("posterior", posterior(rules, prior, accuracies)).withColumns(
        {"base_failed": base_failed(), "kept": ~base_failed() & (F.col("posterior") >= threshold)}
    )
