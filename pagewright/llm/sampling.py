"""Bounded samples for models that need no more rows, however many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 40


def bounded_sample(frame: DataFrame, rows: int, *key: str) -> DataFrame:
    """``rows`` rows of ``frame`` at most, those with the smallest hashes of ``key``, as column ``turn``.

    A first filter by hash keeps about twice as many rows in all tasks together, so what meets in the task
    that picks the smallest does not grow with the number of tasks. Small tables are taken whole.
    """
    hashed = frame.withColumn("turn", F.pmod(F.xxhash64(*key), F.lit(_RANGE)))
    bound = min(1.0, (2 * rows + 200) / max(1, frame.count()))
    return hashed.where(F.col("turn") < int(bound * _RANGE)).orderBy("turn", *key).limit(rows)


def bounded_pieces(frame: DataFrame, text: str, size: int, rows: int, *key: str) -> DataFrame:
    """``rows`` pieces of ``size`` characters of ``text`` at most, from all places of all rows, as columns ``key`` and ``text``.

    The pieces are those with the smallest hashes of ``key`` and their number in the row, by ``bounded_sample``'s
    filter; those it leaves out are never cut. An empty text is one piece.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.lit(1), F.ceil(F.length(whole) / size)).cast("int")
    bound = min(1.0, (2 * rows + 200) / max(1, frame.agg(F.sum(n)).first()[0] or 0))
    turn = lambda i: F.pmod(F.xxhash64(*key, i), F.lit(_RANGE))
    near = F.filter(F.sequence(F.lit(0), n - 1), lambda i: turn(i) < int(bound * _RANGE))
    cut = F.transform(near, lambda i: F.struct(turn(i).alias("turn"), i.alias("piece"), F.substring(whole, i * size + 1, F.lit(size)).alias("text")))
    pieces = frame.select(*key, F.explode(cut).alias("cut")).select(*key, "cut.*")
    return pieces.orderBy("turn", *key, "piece").limit(rows)
