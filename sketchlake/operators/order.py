"""A global order without a global sort in one task: ranges, ranks within them, and offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlake.session import checkpoint


def with_place(frame: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """The rows with their position (from 1) in an order that leaves no ties.

    Rows are dealt to tasks by range and numbered there; written once, so that the numbers stay; what meets in one
    task is a count per range.
    """
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = checkpoint(frame.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), within.alias("_within")))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row per range
    return dealt.join(F.broadcast(before), "_range").select(*frame.columns, (F.col("_before") + F.col("_within") + 1).cast("long").alias(name))


def with_running_sum(frame: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` up to and with them, in an order that leaves no ties; a range of the order is a task, and a sum per range meets in one."""
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(frame.repartitionByRange(ranges, *order).select("*", F.spark_partition_id().alias("_range")))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_n"))
    before = sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row per range
    upto = F.sum(value).over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").select(*frame.columns, (upto + F.col("_before")).alias(name))


def median(frame: DataFrame, value: str, name: str = "median") -> DataFrame:
    """One row: the exact median of a column without nulls (null without rows), from counts of its distinct values; no task holds them all."""
    counted = frame.groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    ranked = with_running_sum(counted, [F.col("_v")], "_k", "_upto")
    whole = ranked.agg(F.sum("_k").alias("_n"))  # one row
    low, high = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)
    holds = lambda at: F.max(F.when((F.col("_upto") >= at) & (F.col("_upto") - F.col("_k") < at), F.col("_v")))
    return ranked.join(F.broadcast(whole)).agg(((holds(low) + holds(high)) / 2).alias(name))
