"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is the number of times its documents should appear on average: its target share
of the wanted amount, divided by the amount it has. Every document draws its number of copies from a Poisson
distribution with that mean, by inverting the distribution at a uniform number hashed from seed and doc_id.
So the draw needs no state, is the same in every run and every order, and the expected amount of each source
is exact. Copies are exploded and sorted by a hash of seed, doc_id and copy number, a global shuffle.

Defined results: rows without source form one source of their own; rows without doc_id draw as if it were
the empty string; rows that repeat a doc_id draw alike; a source without target weight, or with weight 0, is
left out; a target source without rows gets nothing and the others keep their shares of the wanted amount;
an empty table gives no rows. Empty texts count by ``unit`` like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.binding import let
from pagewright.storage import materialize

#: Means above it are drawn as sums of equal parts, so that exp(-mean) stays far from zero.
PART = 32.0
#: P(more than this | mean 32) < 2 ** -53, the resolution of the uniform numbers.
MOST = 100
SALTS = 64
#: Up to this many sources the rates are sent to every task; more are joined by source and salt.
BROADCAST_SOURCES = 50_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 digest of the parts joined by ':'."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", *texts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ..., MOST as an array."""
    first = F.exp(-mean)
    zero = F.struct(first.alias("term"), F.array(first).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        total = F.element_at(state["sums"], -1) + term
        return F.struct(term.alias("term"), F.array_append(state["sums"], total).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), zero, step)["sums"]


def source_rates(docs: DataFrame, targets: DataFrame | None, temperature: float, total: float, unit: str) -> DataFrame:
    """source, amount, rate, parts and the distribution of one part, for each source of ``docs``.

    ``targets`` has source and weight; without it a source's weight is its amount to the power
    ``temperature``. ``total`` is the wanted amount as a multiple of what there is.
    """
    amounts = docs.groupBy("source").agg(F.sum(unit).cast("double").alias("amount"))
    if targets is None:
        weighted = amounts.withColumn("weight", F.pow("amount", F.lit(temperature)))
    else:
        wanted = targets.groupBy(F.col("source").alias("wanted")).agg(F.sum("weight").cast("double").alias("weight"))
        weighted = amounts.join(wanted, amounts["source"].eqNullSafe(wanted["wanted"])).drop("wanted")
    weighted = materialize(weighted.where("weight > 0 AND amount > 0"))
    # Sums over sources in a fixed order, so that the rates are the same doubles in every run.
    ordered = F.array_sort(F.collect_list(F.struct("weight", "amount")))
    sums = weighted.agg(ordered.alias("sources")).select(
        F.aggregate("sources", F.lit(0.0), lambda total, x: total + x["weight"]).alias("weight"),
        F.aggregate("sources", F.lit(0.0), lambda total, x: total + x["amount"]).alias("amount"),
    )
    every = sums.first()
    rate = F.col("weight") / F.lit(every["weight"]) * F.lit(float(total)) * F.lit(every["amount"]) / F.col("amount")
    rated = weighted.withColumn("rate", rate)
    rated = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    return rated.select("source", "amount", "rate", "parts", distribution(F.col("rate") / F.col("parts")).alias("sums"))


def copies(seed: int, key: Column, parts: Column, sums: Column) -> Column:
    """Number of copies: the sum over the parts of the smallest k with P(X <= k) > u."""

    def draw(part: Column) -> Column:
        return let(
            uniform(F.lit(seed), key, part), lambda u: F.size(F.filter(sums, lambda bound: bound <= u))
        )

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, part: n + draw(part))


def replicated(
    docs: DataFrame,
    targets: DataFrame | None = None,
    temperature: float = 0.7,
    total: float = 1.0,
    unit: str = "characters",
    seed: int = 17,
) -> DataFrame:
    """Every document as often as it was drawn, in a globally shuffled order.

    Columns: ``doc``, a struct of all columns of the input row, ``rate``, ``copies``, ``copy`` (from 0) and
    ``place``, the number the rows are sorted by. ``unit``: what weights and amounts count, "characters" or
    "documents".
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    size = F.length(F.coalesce("text", F.lit(""))) if unit == "characters" else F.lit(1)
    rows = docs.select(every, F.col("source").alias("source"), size.cast("long").alias("_size"))
    rates = materialize(source_rates(rows, targets, temperature, total, "_size"))
    rates = rates.select(F.col("source").alias("_source"), "rate", "parts", "sums")
    same = rows["source"].eqNullSafe(rates["_source"])
    if rates.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), same)
    else:
        # A hot source is dealt out over SALTS tasks; the few columns of its rate are repeated.
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc.doc_id"), F.lit(SALTS)))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")
        rates = rates.withColumn("_salted", salts)
        same = rows["source"].eqNullSafe(rates["_source"]) & (rows["_salt"] == rates["_salted"])
        joined = rows.join(rates, same)
    key = F.col("doc.doc_id")
    drawn = joined.select("doc", "rate", copies(seed, key, F.col("parts"), F.col("sums")).alias("copies"))
    each = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    exploded = drawn.where("copies > 0").select("doc", "rate", "copies", each.alias("copy"))
    placed = exploded.withColumn("place", uniform(F.lit(seed), F.lit("place"), key, F.col("copy")))
    return placed.orderBy("place", key, "copy")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The shuffled copies with the columns of ``docs``; options as for ``replicated``."""
    return replicated(docs, **options).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
