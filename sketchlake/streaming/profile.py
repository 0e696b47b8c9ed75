"""Profiling of reads as they arrive: each micro-batch is assigned in exact mode and its coverage kept.

    profile_stream(stream, ref, mode, store)     # store: a folder, one Parquet batch per epoch
    current_coverage(spark, store)

A batch's coverage is written under its epoch, so a replayed epoch overwrites
itself and counts once. Coverage adds up over batches, differences take their
minimum, weights their maximum, exactly as one batch over all reads would. ``compact``
folds finished epochs into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sketchlake.operators import readwise as R


def merge(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("gid", "hctx").agg(
        F.least(F.sum("cov"), F.lit(R.COVERAGE_MAX)).alias("cov"), F.min("diff").alias("diff"), F.max("weight").alias("weight")
    )


def profile_stream(reads: DataFrame, ref: DataFrame, mode: str, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query over a stream of ``unit, hctx, obj``; units must not be split between batches."""

    def keep(batch: DataFrame, epoch: int) -> None:
        R.coverage(R.assign(R.candidates(batch, ref), mode)).write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    return reads.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_coverage(spark: SparkSession, store: str) -> DataFrame:
    return merge(spark.read.parquet(store).drop("epoch"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: counts and sums per event-time window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
