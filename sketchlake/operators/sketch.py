"""Building sketches: distinct entries, conflicts, bottom-k, density, counts and metadata.

Entries are rows ``gid, hctx, obj, cnt``: a sample, a hashed context, the object
in it and how often it was seen. All operators are grouped aggregates or
windows over (gid) or (gid, hctx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlake.functions.hashing import OBJECT_BITS, hash_contexts
from sketchlake.session import checkpoint

HASH_BITS = 64 - OBJECT_BITS


def entries(rows: DataFrame, sample: str, context: str, obj: str, object_bits: int = OBJECT_BITS) -> DataFrame:
    """Distinct entries with their counts, of any table that has a sample, a context and an object column; nulls are left out."""
    return hashed(rows, sample, context, obj, object_bits).groupBy("gid", "hctx", "obj").agg(F.count("*").alias("cnt"))


def hashed(rows: DataFrame, sample: str, context: str, obj: str, object_bits: int = OBJECT_BITS) -> DataFrame:
    """``gid, hctx, obj`` of each row that has all three."""
    named = rows.select(F.col(sample).cast("long").alias("gid"), F.col(context).cast("long").alias("ctx"), F.col(obj).cast("int").alias("obj")).dropna()
    return hash_contexts(named, "ctx", "hctx", object_bits).select("gid", "hctx", "obj")


def positions(rows: DataFrame, order: str) -> DataFrame:
    """Entries with count and smallest position."""
    return rows.groupBy("gid", "hctx", "obj").agg(F.count("*").alias("cnt"), F.min(order).alias("pos"))


def drop_conflicts(sketch: DataFrame) -> DataFrame:
    """Without all entries of a sample's context that has two or more objects; entries are distinct, so one row is one object."""
    others = [c for c in sketch.columns if c not in ("gid", "hctx")]
    counted = sketch.groupBy("gid", "hctx").agg(F.count("*").alias("_objects"), *[F.min(c).alias(c) for c in others])
    return counted.where("_objects = 1").select(*sketch.columns)


def bottom_k(sketch: DataFrame, k: int) -> DataFrame:
    """The first k entries of each sample by (hctx, obj); Spark limits each map task's part first."""
    rank = F.row_number().over(Window.partitionBy("gid").orderBy("hctx", "obj"))
    return sketch.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def unsigned(hashed: Column | str) -> Column:
    """A signed number that orders 64-bit hashes as unsigned ones."""
    return (F.col(hashed) if isinstance(hashed, str) else hashed).bitwiseXOR(F.lit(-(2**63)))


def wide_bottom_k(sketch: DataFrame, k: int) -> DataFrame:
    """All entries of the first k contexts of each sample in the order of their unsigned 64-bit hashes."""
    at = F.dense_rank().over(Window.partitionBy("gid").orderBy(unsigned("hctx")))
    return sketch.withColumn("_rank", at).where(F.col("_rank") <= k).drop("_rank")


def wide_build(sketch: DataFrame, k: int) -> DataFrame:
    """A fixed-size sketch of the wide layout; contexts with two objects or more go first."""
    return wide_bottom_k(drop_conflicts(sketch), k)


def wide_densities(before: DataFrame, k: int) -> DataFrame:
    """Of the wide layout, per sample: the last context's hash of its sketch of size k (2**64 - 1 if nothing was cut), as a decimal, and observed and estimated contexts up to there, before and after conflict removal."""
    contexts = before.groupBy("gid", "hctx").agg((F.count("*") == 1).alias("clean")).withColumn("_at", unsigned("hctx"))
    first = F.row_number().over(Window.partitionBy("gid").orderBy("_at"))
    last = contexts.where("clean").withColumn("_rank", first).where(F.col("_rank") <= k).groupBy("gid").agg(F.max("_at").alias("_last"))
    limits = contexts.groupBy("gid").agg(F.sum(F.col("clean").cast("long")).alias("n")).join(last, "gid").select("gid", F.when(F.col("n") <= k, F.lit(2**63 - 1)).otherwise(F.col("_last")).alias("_limit"))
    counted = contexts.join(limits, "gid").where(F.col("_at") <= F.col("_limit")).groupBy("gid", "_limit").agg(F.count("*").alias("observed_pre"), F.sum(F.col("clean").cast("long")).alias("observed_post"))
    threshold = (F.col("_limit").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)")
    estimate = lambda c: F.when(F.col("_limit") == 2**63 - 1, F.col(c)).otherwise(F.floor(F.col(c) * F.lit(float(2**64)) / (threshold.cast("double") + 1.0) + 0.5).cast("long"))
    return counted.select("gid", threshold.alias("threshold"), "observed_pre", estimate("observed_pre").alias("estimate_pre"), "observed_post", estimate("observed_post").alias("estimate_post"))


def build(sketch: DataFrame, k: int, conflict: bool = False) -> DataFrame:
    """A fixed-size sketch: conflicts go first (unless kept), then the size is cut."""
    return bottom_k(sketch if conflict else drop_conflicts(sketch), k)


def below_density(sketch: DataFrame, threshold: int | Column) -> DataFrame:
    return sketch.where(F.col("hctx") <= threshold)


def min_count(sketch: DataFrame, n: int) -> DataFrame:
    return sketch.where(F.col("cnt") >= n)


def percentile_cutoffs(sketch: DataFrame, percentile: float, base: int = 1, cap: int | None = None) -> DataFrame:
    """``gid, cutoff``: the smallest count at which the cumulated weight of counts from ``base`` on reaches the percentile of all their weight.

    Samples without such counts keep ``base``. Counts are first reduced to a histogram per sample.
    """
    histogram = sketch.groupBy("gid", "cnt").agg((F.count("*") * F.col("cnt")).alias("weight")).where(F.col("cnt") >= base)
    by = Window.partitionBy("gid")
    reached = F.sum("weight").over(by.orderBy("cnt")) >= F.greatest(F.ceil(F.lit(percentile) * F.sum("weight").over(by)), F.lit(1))
    cutoffs = histogram.withColumn("_reached", reached).where("_reached").groupBy("gid").agg(F.min("cnt").alias("cutoff"))
    every = sketch.select("gid").distinct().join(cutoffs, "gid", "left").select("gid", F.coalesce("cutoff", F.lit(base)).cast("long").alias("cutoff"))
    return every.withColumn("cutoff", F.least("cutoff", F.lit(cap))) if cap is not None else every


def filter_counts(sketch: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return sketch.join(cutoffs, "gid").where(F.col("cnt") >= F.col("cutoff")).drop("cutoff")


def density_estimate(observed: Column, threshold: Column, hash_bits: int = HASH_BITS) -> Column:
    """How many contexts the whole hash range would hold."""
    space = float(2**hash_bits)
    scaled = F.floor(observed * F.lit(space) / (threshold.cast("double") + 1.0) + 0.5)
    return F.when((observed == 0) | (threshold >= F.lit(2**hash_bits - 1)), observed).otherwise(scaled)


def context_densities(before: DataFrame, k: int, hash_bits: int = HASH_BITS) -> DataFrame:
    """Per sample: the density threshold of its sketch of size k, and observed and estimated contexts before and after conflict removal.

    The threshold is the last kept context, or the whole range if nothing was cut.
    """
    contexts = before.groupBy("gid", "hctx").agg((F.count("*") == 1).alias("clean"))
    first = F.row_number().over(Window.partitionBy("gid").orderBy("hctx"))  # each map task passes on k of a sample at most
    last = contexts.where("clean").withColumn("_rank", first).where(F.col("_rank") <= k).groupBy("gid").agg(F.max("hctx").alias("last"))
    sizes = contexts.groupBy("gid").agg(F.sum(F.col("clean").cast("long")).alias("n")).join(last, "gid", "left")
    threshold = F.when(F.col("n") <= k, F.lit(2**hash_bits - 1)).otherwise(F.col("last"))
    within = contexts.join(sizes.select("gid", threshold.alias("threshold")), "gid").where(F.col("hctx") <= F.col("threshold"))
    counted = within.groupBy("gid", "threshold").agg(F.count("*").alias("pre"), F.sum(F.col("clean").cast("long")).alias("post"))
    estimate = lambda c: density_estimate(F.col(c), F.col("threshold"), hash_bits).cast("long")
    return counted.select("gid", "threshold", F.col("pre").alias("observed_pre"), estimate("pre").alias("estimate_pre"), F.col("post").alias("observed_post"), estimate("post").alias("estimate_post"))


def _single(rows: DataFrame) -> DataFrame:
    """Entries of contexts without conflict, of rows ``gid, hctx, obj``, each as often as seen: where the smallest and the largest object are one."""
    return rows.groupBy("gid", "hctx").agg(F.min("obj").alias("obj"), F.max("obj").alias("_last"), F.count("*").alias("cnt")).where("obj = _last").drop("_last")


def build_rows(rows: DataFrame, k: int) -> DataFrame:
    """``build`` of rows ``gid, hctx, obj``, each as often as seen, without dealing their distinct entries first."""
    return bottom_k(_single(rows), k)


def build_with_densities(rows: DataFrame, k: int, hash_bits: int = HASH_BITS) -> tuple[DataFrame, DataFrame]:
    """The sketch ``gid, hctx, obj`` of size k of ``rows`` (each as often as seen), written, and ``gid, threshold, estimate_post`` of its samples as ``context_densities`` has them.

    Neither distinct entries nor all contexts are dealt: the threshold needs no more than the first k + 1 contexts without conflict.
    """
    rank = F.row_number().over(Window.partitionBy("gid").orderBy("hctx"))
    kept = checkpoint(_single(rows).drop("cnt").withColumn("_rank", rank).where(F.col("_rank") <= k + 1))
    inside = F.col("_rank") <= k
    limits = kept.groupBy("gid").agg(F.count("*").alias("_n"), F.max(F.when(inside, F.col("hctx"))).alias("_last"))
    limits = limits.select("gid", F.when(F.col("_n") > k, F.col("_last")).otherwise(F.lit(2**hash_bits - 1)).alias("threshold"), F.least("_n", F.lit(k)).alias("_post"))
    return kept.where(inside).drop("_rank"), limits.select("gid", "threshold", density_estimate(F.col("_post"), F.col("threshold"), hash_bits).cast("long").alias("estimate_post"))


def density_summary(densities: DataFrame) -> DataFrame:
    """The smallest and largest threshold of a set, with the samples that have them (the lowest id on ties)."""
    low, high = F.min(F.struct("threshold", "gid")), F.min(F.struct((-F.col("threshold")).alias("t"), "gid"))
    return densities.agg(low.alias("l"), high.alias("h"), F.count("*").alias("n_samples")).select(
        "n_samples", F.col("l.threshold").alias("min_threshold"), F.col("l.gid").alias("min_gid"), (-F.col("h.t")).alias("max_threshold"), F.col("h.gid").alias("max_gid")
    )


def input_metadata(records: DataFrame, sample: str, length: str, fasta: Column) -> DataFrame:
    """Per sample: total length, records, median (whole mean of the middle two), variation, and longest share (fasta) or 0.

    ``fasta`` is a boolean over the sample. The median comes from a histogram of
    lengths, not from a sort of all records in one task.
    """
    named = records.select(F.col(sample).cast("long").alias("gid"), F.col(length).cast("long").alias("len")).dropna()
    histogram = named.groupBy("gid", "len").agg(F.count("*").alias("n"))
    by = Window.partitionBy("gid")
    upto = F.sum("n").over(by.orderBy("len"))
    total = F.sum("n").over(by)
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    hit = lambda at: F.when((upto > at) & (upto - F.col("n") <= at), F.col("len"))
    placed = histogram.withColumn("a", hit(low)).withColumn("b", hit(high))
    mean = F.sum(F.col("len") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("len").cast("double") * F.col("len") * F.col("n")) / F.sum("n")
    out = placed.groupBy("gid").agg(
        F.sum(F.col("len") * F.col("n")).alias("total_bp"), F.sum("n").alias("n_records"), F.floor((F.max("a") + F.max("b")) / 2).cast("long").alias("median_bp"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd"), mean.alias("mean"), F.max("len").alias("longest"),
    )
    cv = F.when((F.col("mean") > 0) & (F.col("n_records") > 1), F.col("sd") / F.col("mean")).otherwise(F.lit(0.0))
    level = F.when(fasta & (F.col("total_bp") > 0), F.col("longest") / F.col("total_bp")).when(fasta, F.lit(-1.0)).otherwise(F.lit(0.0))
    return out.select("gid", "total_bp", "n_records", "median_bp", cv.alias("len_cv"), level.alias("asm_level"), fasta.alias("is_fasta"))


def annotation(records: DataFrame, sample: str, order: str, text: Column) -> DataFrame:
    """The first record's header text of each sample."""
    return records.groupBy(F.col(sample).cast("long").alias("gid")).agg(F.min_by(text, order).alias("annotation"))


def sizes(sketch: DataFrame, samples: DataFrame) -> DataFrame:
    """Entries and distinct contexts per sample, samples without entries included."""
    counted = sketch.groupBy("gid").agg(F.count("*").alias("n_entries"), F.count_distinct("hctx").alias("n_ctx"))
    return samples.select("gid").join(counted, "gid", "left").fillna(0, ["n_entries", "n_ctx"])


def context_index(sketch: DataFrame) -> DataFrame:
    """Per context: its entries and samples, and whether one sample only has it."""
    return sketch.groupBy("hctx").agg(F.count("*").alias("n_entries"), F.count_distinct("gid").alias("n_samples"), F.min("gid").alias("first_gid")).withColumn("marker", F.col("n_samples") == 1)


def sample_index(sketch: DataFrame) -> DataFrame:
    """Per sample: contexts and those in conflict."""
    per = sketch.groupBy("gid", "hctx").agg(F.count("*").alias("objects"))
    return per.groupBy("gid").agg(F.count("*").alias("n_ctx"), F.sum((F.col("objects") > 1).cast("long")).alias("n_conflict"))


def count_histogram(sketch: DataFrame) -> DataFrame:
    return sketch.groupBy("gid", "cnt").agg(F.count("*").alias("n"))
