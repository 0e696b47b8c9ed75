"""Abundance from shared unique k-mers, and similarity search over abundance vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchlake.operators import pairs as P
from sketchlake.operators.order import with_place
from sketchlake.session import checkpoint

MIN_SHARED = 6


def species_abundance(query: DataFrame, ref: DataFrame) -> DataFrame:
    """``qry, ref, n, mean, range_mean, median, max`` of the query's counts of the contexts shared with each reference.

    The median is the element at n / 2; the range mean sums ranks from 0.98 n up
    to 0.99 n, with divisor 0.99 n - first + 1 cut to a whole number. Pairs share at least MIN_SHARED. Ranks come from a histogram of counts per pair.
    """
    asks = query.select("gid", "hctx", F.col("cnt").alias("value"), F.lit(True).alias("asks"), F.lit(False).alias("answers"))
    rows = asks.union(ref.select("gid", "hctx", F.lit(None).cast(asks.schema["value"].dataType), F.lit(False), F.lit(True)))
    lists = P.context_lists(rows, {"refs": lambda x: x["gid"]}, carried=["own"])
    shared = P.dealt_by_query(lists, rows).select("qry", F.col("own").alias("cnt"), F.explode("refs").alias("ref"))
    histogram = shared.groupBy("qry", "ref", "cnt").agg(F.count("*").alias("k"))
    by = Window.partitionBy("qry", "ref")
    rows = histogram.withColumn("upto", F.sum("k").over(by.orderBy("cnt"))).withColumn("n", F.sum("k").over(by)).where(F.col("n") >= MIN_SHARED)
    before = F.col("upto") - F.col("k")
    first = F.floor(F.col("n") * F.lit(0.98))
    last = F.ceil(F.col("n") * F.lit(0.99))  # ranks below 0.99 n
    inside = F.greatest(F.least(F.col("upto"), last) - F.greatest(before, first), F.lit(0))
    middle = F.floor(F.col("n") / 2)
    rows = rows.withColumn("inside", inside).withColumn("mid", F.when((F.col("upto") > middle) & (before <= middle), F.col("cnt")))
    divisor = F.floor(F.col("n") * F.lit(0.99) - first + 1)
    return rows.groupBy("qry", "ref", "n").agg(
        (F.sum(F.col("cnt") * F.col("k")) / F.col("n")).alias("mean"), (F.sum(F.col("cnt") * F.col("inside")) / divisor).alias("range_mean"), F.max("mid").alias("median"), F.max("cnt").alias("max")
    )


def to_vectors(abundance: DataFrame) -> DataFrame:
    """Sparse vectors ``sample, dim, pct`` of pairs with a median over 1 and more than MIN_SHARED + 1 shared: shares of the excess over 1, in percent."""
    kept = abundance.where((F.col("median") > 1) & (F.col("n") > MIN_SHARED + 1))
    by = Window.partitionBy("qry")
    whole = F.sum("range_mean").over(by) - F.count("*").over(by)
    return kept.withColumn("whole", whole).select(F.col("qry").alias("sample"), F.col("ref").alias("dim"), ((F.col("range_mean") - 1) * 100 / F.col("whole")).alias("pct"))


#: Queries whose results a task holds at most, and at least so that a block's index entries serve several of them.
BLOCK_MOST, BLOCK_LEAST = 1024, 64


def search(query: DataFrame, index: DataFrame, measure: str) -> DataFrame:
    """``qry, ref, value`` of samples that share a dimension: cosine, l1 (unmatched shares of 100 count whole) or l2 (matched dimensions only).

    Products of shared dimensions are many times their sums, so none is dealt: queries go in blocks of neighbouring ids, and each block gets the entries of the
    index in its dimensions. A task multiplies and sums up a block's.
    """
    if measure not in ("cosine", "l1", "l2"):
        raise ValueError(f"cosine, l1 or l2: {measure!r}")
    c = F.col
    pct = c("pct") / F.sqrt(F.sum(c("pct") * c("pct")).over(Window.partitionBy("sample"))) if measure == "cosine" else c("pct")
    x, y = (rows.select("sample", "dim", pct.alias("v")) for rows in (query, index))
    n = int(query.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = with_place(query.select("sample").distinct(), [c("sample")], "_at")
    samples = placed.count()
    size = min(BLOCK_MOST, max(BLOCK_LEAST, -(-samples // (2 * n))))
    x = checkpoint(x.join(placed, "sample").select(F.floor((c("_at") - 1) / size).alias("_block"), "dim", "sample", "v"))
    needed = y.join(x.select("_block", "dim").distinct(), "dim").select("_block", "dim", "sample", "v")
    sides = x.withColumn("asks", F.lit(True)).union(needed.withColumn("asks", F.lit(False)))
    entry = F.struct("sample", "v")
    met = sides.repartition(max(n, -(-samples // size)), "_block").groupBy("_block", "dim").agg(F.collect_list(F.when(c("asks"), entry)).alias("_x"), F.collect_list(F.when(~c("asks"), entry)).alias("_y"))
    pairs = met.select("_block", "_y", F.inline("_x").alias("qry", "x")).select("_block", "qry", "x", F.inline("_y").alias("ref", "y")).groupBy("_block", "qry", "ref")
    gap = c("x") - c("y")
    value = {"cosine": F.sum(c("x") * c("y")), "l1": F.sum(F.abs(gap)) + 200 - F.sum("x") - F.sum("y"), "l2": F.sqrt(F.sum(gap * gap))}[measure]
    return pairs.agg(value.alias("value")).select("qry", "ref", "value")
