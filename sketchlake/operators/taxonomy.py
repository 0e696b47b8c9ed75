"""Taxonomy: key fallback, lowest common ancestors and profiles by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks by depth of a lineage.
RANKS = ("root", "superkingdom", "phylum", "class", "order", "family", "genus", "species", "strain")


def accession(name: Column) -> Column:
    """The first assembly or sequence accession in a name, or an empty string."""
    return F.regexp_extract(name, r"(GC[FA]_[0-9]*(?:\.[0-9]*)?|N[CZ]_[A-Za-z0-9_.]*)", 1)


def match_keys(refs: DataFrame, taxmap: DataFrame) -> DataFrame:
    """References with their taxonomy records: by name, base name, accession, annotation, its accession; the first key that hits wins."""
    base = F.regexp_extract("name", r"([^/]*)$", 1)
    note = F.coalesce(F.col("annotation"), F.lit(""))
    keys = F.array(F.col("name"), base, accession(F.col("name")), note, accession(note))
    tried = refs.select("gid", F.posexplode(keys).alias("priority", "ref_key")).where("ref_key <> ''")
    hits = tried.join(taxmap, "ref_key")
    return hits.withColumn("_first", F.min("priority").over(Window.partitionBy("gid"))).where(F.col("priority") == F.col("_first")).drop("_first", "priority", "ref_key")


def lca(members: DataFrame, group: str, path: str, separator: str = "|") -> DataFrame:
    """``group, depth, rank, name``: the longest common lineage of each group's members; missing and NA lineages are ignored.

    What all lineages of a group share, its smallest and largest share, so two of them
    are all that an aggregate keeps of a group.
    """
    tokens = F.split(F.col(path), rf"\{separator}")
    levels = members.where(F.col(path).isNotNull() & ~F.col(path).isin("", "NA")).select(group, tokens.alias("t"))
    ends = levels.groupBy(group).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    same = F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
    differ = F.array_position(same, F.lit(False))
    depth = F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int")
    ends = ends.select(group, depth.alias("depth"), "lo")
    rank = F.element_at(F.array(*[F.lit(r) for r in RANKS]), F.least(F.col("depth"), F.lit(len(RANKS) - 1)) + 1)
    return ends.select(group, F.col("depth").cast("long").alias("depth"), rank.alias("rank"), F.coalesce(F.try_element_at("lo", F.nullif(F.col("depth"), F.lit(0))), F.lit("NA")).alias("name"))


def profile(abundance: DataFrame, matched: DataFrame) -> DataFrame:
    """Per (taxid, rank, path): the share of the printed abundance, in percent of its rank."""
    rows = abundance.where("abundance > 0").join(matched, "gid").groupBy("taxid", "rank", "taxpath").agg(F.sum("abundance").alias("abundance"))
    whole = rows.groupBy("rank").agg(F.sum("abundance").alias("whole"))
    return rows.join(whole, "rank").select("taxid", "rank", "taxpath", (100 * F.col("abundance") / F.col("whole")).alias("percentage"))


def deepest(matched: DataFrame) -> DataFrame:
    """Of each reference's records (``gid, taxid, rank, taxpath``), the one of the deepest rank, then of the longest lineage; the smaller taxid on ties.

    Ranks that aren't known lie above all others.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.lower(F.coalesce("rank", F.lit(""))))
    length = F.size(F.split(F.coalesce("taxpath", F.lit("")), r"\|"))
    first = F.min(F.struct((-rank).alias("r"), (-length).alias("l"), "taxid", "rank", "taxpath"))
    return matched.groupBy("gid").agg(first.alias("b")).select("gid", "b.taxid", "b.rank", "b.taxpath")
