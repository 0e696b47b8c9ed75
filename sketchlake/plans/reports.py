"""Report layouts: column orders, square matrices and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchlake.operators.order import with_place

EDGE_COLUMNS = ("a", "b", "distance", "xny", "max_af")


def write_tsv(frame: DataFrame, path: str) -> None:
    frame.write.csv(path, sep="\t", header=True)


def phylip_ids(samples: DataFrame) -> DataFrame:
    """``gid, id``: ten-character identifiers by position."""
    return with_place(samples.select("gid"), [F.col("gid")]).select("gid", F.format_string("S%09d", "place").alias("id"))


def phylip_lines(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """``ord, line``: a head line with the number of samples, then one line per sample; cells of a row are joined in sample order."""
    ids = phylip_ids(samples)
    rows = matrix.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "distance"))), lambda c: F.format_number(c["distance"], 6)).alias("cells"))
    body = rows.join(ids, rows["row"] == ids["gid"]).select(F.col("gid").alias("ord"), F.concat_ws(" ", "id", F.array_join("cells", " ")).alias("line"))
    head = samples.agg(F.lit(-1).cast("long").alias("ord"), F.count("*").cast("string").alias("line"))
    return head.unionByName(body)


def profile_text(percentages: DataFrame, sample: str) -> DataFrame:
    """``ord, line``: a taxonomic profile by rank."""
    placed = with_place(percentages, [F.asc("rank"), F.desc("percentage"), F.asc("taxid"), F.asc("taxpath")], "ord")
    body = placed.select("ord", F.concat_ws("\t", "taxid", "rank", "taxpath", F.format_number("percentage", 6)).alias("line"))
    head = percentages.sparkSession.createDataFrame([(-2, f"@SampleID:{sample}"), (-1, "@@TAXID\tRANK\tTAXPATH\tPERCENTAGE")], "ord long, line string")
    return head.unionByName(body)
