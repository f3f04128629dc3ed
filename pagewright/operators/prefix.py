"""Running sums over large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.storage import materialize


def running_total(frame: DataFrame, group: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows of the group that come before in ``order``; without a group, of all rows.

    Rows are dealt to tasks by ranges of group and order, so a group with a third of all rows is many slices. Sums of
    whole slices give each slice its offset; only inside a slice are rows summed one by one. Equal places in the order follow each
    other in any order.
    """
    ranged = frame.withColumn("_amount", amount).repartitionByRange(*group, *order)
    sliced = materialize(ranged.withColumn("_slice", F.spark_partition_id()))
    before = (Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*group, "_slice").agg(F.sum("_amount").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(*before))
    offsets = sums.withColumn("_offset", earlier).drop("_sum")
    inside = F.sum("_amount").over(Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(*before))
    zero = F.lit(0).cast(sliced.schema["_amount"].dataType)
    keys = [sliced[c].eqNullSafe(offsets[c]) for c in (*group, "_slice")]
    whole = sliced.withColumn("_inside", inside).join(offsets, keys, "left").drop(*[offsets[c] for c in (*group, "_slice")])
    total = F.coalesce("_offset", zero) + F.coalesce("_inside", zero)
    return whole.withColumn(name, total).select(*[F.col(f"`{c}`") for c in frame.columns], name)
