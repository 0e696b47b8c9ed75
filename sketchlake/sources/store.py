"""Sketch sets on disk: entries, samples and layout as Parquet, and bucketed indexes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlake.operators.setops import check_compatible


@dataclass(frozen=True)
class Layout:
    target_size: int
    ctx_bits: int = 44
    obj_bits: int = 20
    seed: int = 0x9E3779B97F4A7C15
    selection: str = "bottom-k"
    conflict: bool = False
    has_counts: bool = True


@dataclass
class SketchSet:
    """``entries`` (gid, hctx, obj, cnt) of ``samples`` (gid and what is known of them), all of one layout."""

    entries: DataFrame
    samples: DataFrame
    layout: Layout

    def save(self, path: str) -> None:
        """Writes a new folder; entries are clustered by context so that density cuts prune row groups."""
        self.entries.repartitionByRange("hctx").sortWithinPartitions("hctx", "gid").write.parquet(f"{path}/entries")
        self.samples.write.parquet(f"{path}/samples")
        spark = self.entries.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.layout)),)], "layout string").coalesce(1).write.parquet(f"{path}/layout")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SketchSet:
        layout = Layout(**json.loads(spark.read.parquet(f"{path}/layout").first()[0]))
        return cls(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/samples"), layout)

    def require(self, other: SketchSet) -> None:
        check_compatible(asdict(self.layout), asdict(other.layout))


def write_index(entries: DataFrame, table: str, buckets: int = 256, path: str | None = None) -> None:
    """A table bucketed and sorted by context: joins with it on hctx don't shuffle it. With ``path`` its files lie there."""
    writer = entries.write.bucketBy(buckets, "hctx").sortBy("hctx", "gid").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def open_index(spark: SparkSession, table: str) -> DataFrame:
    """The index as it was written. What joins it on hctx is dealt to its buckets; it is neither shuffled nor read whole where few contexts are asked for."""
    found = spark.table(table)
    if not {"gid", "hctx", "obj"} <= set(found.columns):
        raise ValueError(f"not an index of contexts: {table}")
    return found


# --- entries of reads, kept for further passes -------------------------------------------------------------------------

CACHE_VERSION = 1


@dataclass(frozen=True)
class CacheStamp:
    """What a cache of reads was made with, and how many reads there were and kept entries."""

    threshold: int
    ctx_bits: int = 44
    obj_bits: int = 20
    total_reads: int = 0
    density_reads: int = 0
    version: int = CACHE_VERSION


def write_read_cache(reads: DataFrame, total_reads: int, threshold: int, path: str, ctx_bits: int = 44, obj_bits: int = 20) -> CacheStamp:
    """Writes the entries ``unit, hctx, obj`` of reads up to a density threshold, each range of reads in files of its own, with a stamp.

    A further pass over the same reads replays them without parsing sequences.
    """
    kept = reads.select("unit", "hctx", "obj").where(F.col("hctx") <= threshold).distinct()
    kept.repartitionByRange("unit").sortWithinPartitions("unit", "hctx").write.parquet(f"{path}/entries")
    spark = reads.sparkSession
    number = spark.read.parquet(f"{path}/entries").agg(F.count_distinct("unit").alias("n")).first()["n"]
    stamp = CacheStamp(threshold, ctx_bits, obj_bits, total_reads, number)
    spark.createDataFrame([(json.dumps(asdict(stamp)),)], "value string").coalesce(1).write.text(f"{path}/stamp")  # last: a cache without it isn't one
    return stamp


def replay_reads(spark: SparkSession, path: str, threshold: int, ctx_bits: int = 44, obj_bits: int = 20) -> tuple[DataFrame, CacheStamp]:
    """The entries of a cache and its stamp, if it was made for this layout and density; else an error that says what differs."""
    held = json.loads(spark.read.text(f"{path}/stamp", wholetext=True).first()["value"])
    if held.get("version") != CACHE_VERSION:
        raise ValueError(f"unsupported version of a read cache: {held.get('version')!r}")
    stamp = CacheStamp(**held)
    for name, asked in (("threshold", threshold), ("ctx_bits", ctx_bits), ("obj_bits", obj_bits)):
        if getattr(stamp, name) != asked:
            raise ValueError(f"the read cache's {name} is {getattr(stamp, name)}, not {asked}")
    return spark.read.parquet(f"{path}/entries"), stamp


def read_taxmap(spark: SparkSession, path: str) -> DataFrame:
    """``ref_key, taxid, rank, taxpath, taxpathsn, genome_id, otu`` of a tab-separated map; header and comments are passed over."""
    names = ["ref_key", "taxid", "rank", "taxpath", "taxpathsn", "genome_id", "otu"]
    rows = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"{n} string" for n in names), mode="PERMISSIVE")
    return rows.where("ref_key <> 'ref_key' and taxid <> 'TAXID'")
