"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round moves only edges, aggregates before it shuffles, and writes its edges to the shared folder. The
number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.storage import materialize


def _hung(edges: DataFrame, low: DataFrame, keep) -> DataFrame:
    """Edges from each kept neighbour of a node to the smallest node around it."""
    joined = edges.join(low, "a").where(keep)
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return _hung(both, low, F.col("b") > F.col("a")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    own = low.select("a", F.col("low").alias("b"))
    return _hung(down, low, F.lit(True)).unionByName(own).distinct()


def _state(edges: DataFrame) -> tuple:
    """Two equal values mean equal edge sets."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node it is connected with. ``edges``: columns a, b, not NULL.

    Nodes without an edge to another node are not in the result; an empty table gives no rows.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct())
    state = _state(now)
    while state[0]:
        now = materialize(_small_star(_large_star(now)))
        last, state = state, _state(now)
        if last == state:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
