"""Ranks and running sums in an order, over groups of any size: a range partitioning and the sums of the partitions before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored


def running(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str = "running") -> DataFrame:
    """The rows with the sum of ``value`` over their group up to and with themselves, in an order that has no ties.

    The order partitions the table, so that a large group lies in several tasks; each then sums its part, and a small table of the parts' sums,
    one row a group and part, gives what lies before.
    """
    held = stored(rows.withColumn("_v", value).repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = held.groupBy(*group, "_part").agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*group).orderBy("_part") if group else Window.orderBy("_part")
    before = sums.select(*group, "_part", (F.sum("_s").over(over) - F.col("_s")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return held.join(before, [*group, "_part"]).withColumn(name, inside + F.col("_before")).drop("_v", "_part", "_before")


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str = "k") -> DataFrame:
    """The rows with their number in the group's order, from 1."""
    return running(rows, group, order, F.lit(1), name)


def percentiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``group`` and a column a share: the least value that this share of the group's values (nulls aside) doesn't exceed; exact.

    ``group`` names one column or more.  Equal values are counted first, and running counts over ranges of values say which one it is, so no task holds a group's values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_value")).agg(F.count("*").alias("_count"))
    placed = running(counted, group, [F.col("_value")], F.col("_count"), "_upto")
    both = placed.join(counted.groupBy(*group).agg(F.sum("_count").alias("_total")), group)
    rank = lambda share: F.greatest(F.ceil(F.col("_total") * F.lit(share)), F.lit(1))
    return both.groupBy(*group).agg(*[F.min(F.when(F.col("_upto") >= rank(share), F.col("_value"))).alias(name) for name, share in shares.items()])
