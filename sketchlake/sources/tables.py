"""Tables that come as text: gold profiles, maps of species, and groupings of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlake.operators.taxonomy import accession
from sketchlake.sources.store import read_taxmap

#: Names that aren't species in gold profiles.
NOT_SPECIES = ("unidentified", "unidentified plasmid", "unidentified virus")


def gold_rows(lines: DataFrame) -> DataFrame:
    """``sample, taxid, rank, taxpath, taxpathsn, percentage`` of profile texts given as whole files (``path, value``).

    A file is cut at its sample heads, so every section knows its sample without an order over all lines.
    """
    sections = lines.select("path", F.posexplode(F.split("value", r"(?m)^@SampleID:")).alias("at", "section")).where("at > 0")
    named = sections.select("path", "at", F.trim(F.substring_index("section", "\n", 1)).alias("sample"), F.posexplode(F.split("section", "\n")).alias("line_no", "line")).where("line_no > 0")
    line = F.regexp_replace("line", r"\r$", "")
    fields = F.split(line, "\t")
    rows = named.where(~F.col("line").startswith("@") & (F.size(fields) >= 5)).select("path", "sample", "at", "line_no", *[fields[i].alias(n) for i, n in enumerate(("taxid", "rank", "taxpath", "taxpathsn"))], fields[4].try_cast("double").alias("percentage"))
    return rows.where("taxid <> 'TAXID'")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Species of gold profiles: ``sample, taxid, taxpath, taxpathsn, species, percentage``; the first row of a taxid in a sample counts."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    rows = gold_rows(files).where("rank = 'species' and percentage > 0")
    rows = rows.withColumn("species", F.trim(F.element_at(F.split("taxpathsn", r"\|"), -1))).where(~F.lower("species").isin(*NOT_SPECIES))
    first = F.min_by(F.struct("taxpath", "taxpathsn", "species", "percentage"), F.struct("path", "at", "line_no"))
    return rows.groupBy("sample", "taxid").agg(first.alias("f")).select("sample", "taxid", "f.*")


def species_map(taxmap: DataFrame) -> DataFrame:
    """``ref_key, taxid, taxpath, taxpathsn, species``: species rows of a map, also under the accessions in their keys; own keys win, then the smaller record."""
    rows = taxmap.where("rank = 'species'").withColumn("species", F.coalesce(F.element_at(F.split("taxpathsn", r"\|"), -1), F.lit("")))
    record = F.struct("taxid", "taxpath", "taxpathsn", "species")
    own = rows.select("ref_key", F.lit(0).alias("by"), record.alias("r"))
    alias = rows.select(accession(F.col("ref_key")).alias("ref_key"), F.lit(1).alias("by"), record.alias("r")).where("ref_key <> ''")
    return own.union(alias).groupBy("ref_key").agg(F.min(F.struct("by", "r")).alias("m")).select("ref_key", "m.r.*")


def read_species_map(spark: SparkSession, path: str) -> DataFrame:
    return species_map(read_taxmap(spark, path))


def map_accessions(rows: DataFrame, species: DataFrame) -> DataFrame:
    """Result rows (``accession``) plus ``taxid`` and ``species``: by the accession, else without its version; empty if unknown."""
    short = F.regexp_replace("accession", r"\.[^.]*$", "")
    key = species.select(F.col("ref_key").alias("_k"), F.col("taxid").alias("_t"), F.col("species").alias("_s"))
    full = rows.join(key, F.col("accession") == F.col("_k"), "left").withColumn("_short", short)
    again = key.select(F.col("_k").alias("_k2"), F.col("_t").alias("_t2"), F.col("_s").alias("_s2"))
    out = full.join(again, F.col("_short") == F.col("_k2"), "left")
    return out.withColumns({"taxid": F.coalesce("_t", "_t2", F.lit("")), "species": F.coalesce("_s", "_s2", F.lit(""))}).drop("_k", "_t", "_s", "_short", "_k2", "_t2", "_s2")


def read_grouping(spark: SparkSession, path: str) -> DataFrame:
    """``gid, taxid, name`` of a grouping file, whose line i (from 0) is sample i: a number, perhaps a tab and a name.

    A grouping has a line per sample of one set and is one file; its lines are numbered within it. A taxid with two names is an error
    of ``check_grouping``.
    """
    text = spark.read.text(path, wholetext=True).withColumn("value", F.regexp_replace("value", r"\r?\n$", ""))
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("gid", "line"))
    fields = F.split("line", "\t")
    return lines.select(F.col("gid").cast("long").alias("gid"), F.regexp_extract(fields[0], r"^\s*(-?\d+)", 1).try_cast("long").alias("taxid"), F.get(fields, F.lit(1)).alias("name"))


def check_grouping(groups: DataFrame, n_samples: int) -> None:
    """As many lines as samples, a number on each, and one name per taxid: all else is an error."""
    found = groups.agg(F.count("*").alias("n"), F.count_if(F.col("taxid").isNull()).alias("bad")).first()
    if found["n"] != n_samples:
        raise ValueError(f"{found['n']} lines for {n_samples} samples")
    if found["bad"]:
        raise ValueError("a line without a number")
    name = F.coalesce("name", F.lit(""))
    if not groups.groupBy("taxid").agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a <> b").isEmpty():
        raise ValueError("a taxid with two names")


def group_names(groups: DataFrame) -> DataFrame:
    """``taxid, name, members``: groups are called by taxid and name, or by the taxid alone; taxid 0 is no group."""
    named = groups.where("taxid <> 0").groupBy("taxid").agg(F.max("name").alias("_name"), F.count("*").alias("members"))
    return named.select("taxid", F.concat_ws("_", F.col("taxid").cast("string"), F.nullif(F.col("_name"), F.lit(""))).alias("name"), "members")
