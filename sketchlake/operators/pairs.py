"""Pairs of samples: the join on contexts, features, metrics, matrices and edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlake.functions import distance as D
from sketchlake.operators.order import with_place
from sketchlake.session import checkpoint


def context_counts(sketch: DataFrame) -> DataFrame:
    return sketch.groupBy("gid").agg(F.count_distinct("hctx").alias("n_ctx"))


def without_common(sketch: DataFrame, max_samples: int) -> DataFrame:
    """Without contexts that more than ``max_samples`` samples have (lossy, for nominating candidates only)."""
    common = sketch.groupBy("hctx").agg(F.count_distinct("gid").alias("n")).where(F.col("n") > max_samples).select("hctx")
    return sketch.join(common, "hctx", "left_anti")


def matches(query: DataFrame, ref: DataFrame, triangle: bool = False, conflicts: bool = False) -> DataFrame:
    """``qry, ref, hctx, d``: shared contexts of two sketches with the smallest object distance of their objects.

    With ``triangle`` both are one set and only ref < qry is kept. With
    ``conflicts`` a side may have several objects in a context, and each pair's
    context is reduced to its minimum; without, the join is final as it is.
    """
    q = query.select(F.col("gid").alias("qry"), "hctx", F.col("obj").alias("_q"))
    r = ref.select(F.col("gid").alias("ref"), "hctx", F.col("obj").alias("_r"))
    joined = q.join(r, "hctx")
    if triangle:
        joined = joined.where("ref < qry")
    found = joined.select("qry", "ref", "hctx", D.object_distance(F.col("_q"), F.col("_r")).alias("d"))
    return found.groupBy("qry", "ref", "hctx").agg(F.min("d").alias("d")) if conflicts else found


def features(matched: DataFrame, counts: DataFrame, ref_counts: DataFrame | None = None) -> DataFrame:
    """Per pair: xny, n_diff_obj, n_diff_section, n_mut2, both context counts and fractions."""
    pairs = _summed(matched, ["qry", "ref"])
    q = counts.select(F.col("gid").alias("qry"), F.col("n_ctx").alias("x_ctx"))
    r = (ref_counts or counts).select(F.col("gid").alias("ref"), F.col("n_ctx").alias("y_ctx"))
    return _with_fractions(pairs.join(q, "qry").join(r, "ref"))


def _summed(matched: DataFrame, keys: list[str]) -> DataFrame:
    return matched.groupBy(*keys).agg(
        F.count("*").alias("xny"),
        F.sum((F.col("d") > 0).cast("long")).alias("n_diff_obj"),
        F.sum(F.col("d").cast("long")).alias("n_diff_section"),
        F.sum((F.col("d") > 1).cast("long")).alias("n_mut2"),
    )


def _with_fractions(rows: DataFrame, more: list[str] | None = None) -> DataFrame:
    return rows.select("qry", "ref", "xny", "n_diff_obj", "n_diff_section", "n_mut2", "x_ctx", "y_ctx", (F.col("xny") / F.col("x_ctx")).alias("af_qry"), (F.col("xny") / F.col("y_ctx")).alias("af_ref"), *(more or []))


#: Samples of a context that one list names at most, shared contexts that a task sums up, about, and samples whose few numbers go to every task.
LISTED, TASK_SHARED, NOTED = 1024, 1 << 21, 1 << 20


def context_lists(rows: DataFrame, values: dict[str, Callable[[Column], Column]], keep: Callable[[Column], Column] | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """``qry``, the ``carried`` columns and a list per value: of each entry that asks, the entries of its context that answer, in lists of at most LISTED.

    Lists take a fraction of the room that a row for each shared context takes. ``rows`` are ``gid, hctx, value`` with booleans ``asks`` and ``answers``; ``keep`` and
    ``values`` get an answering entry (``gid``, ``value``). A context of many samples is dealt by its lists, not as one key.
    """
    c, by = F.col, Window.partitionBy("hctx")
    one = c("answers").cast("long")
    placed = rows.withColumns({"_at": F.sum(one).over(by.orderBy("gid").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum(one).over(by)})
    lists = placed.where("answers").groupBy("hctx", F.floor((c("_at") - 1) / LISTED).alias("_part")).agg(F.collect_list(F.struct("gid", "value")).alias("_list"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("_n") - 1) / LISTED)))
    asking = placed.where("asks and _n > 0").select(c("gid").alias("qry"), "hctx", c("value").alias("own"), *carried, parts.alias("_part"))
    met = asking.join(lists, ["hctx", "_part"])
    met = met.withColumn("_list", F.filter("_list", keep)) if keep else met
    return met.where(F.size("_list") > 0).select("qry", *carried, *[F.transform("_list", f).alias(name) for name, f in values.items()])


def dealt_by_query(lists: DataFrame, rows: DataFrame) -> DataFrame:
    """The lists of each query in one task; as many tasks as are set, or more where what ``rows`` share asks for it, so that no task has to spill."""
    shared = rows.groupBy("hctx").agg((F.sum(F.col("asks").cast("long")) * F.sum(F.col("answers").cast("long"))).alias("n")).agg(F.sum("n")).first()[0] or 0
    return lists.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shared // TASK_SHARED)), "qry")


def list_features(sketch: DataFrame, notes: DataFrame | None = None, others: bool = False, conflicts: bool = False) -> DataFrame:
    """``features`` of pairs of a sketch (written, unless it has ``conflicts``), many times its size; shared contexts are dealt once, by query, in lists.

    Pairs have ref < qry, or with ``others`` both orders. With ``conflicts`` a query may have several objects in a context, of which the nearest counts, and
    only contexts with one object are references. What is known of a sample (its contexts, and ``notes``, columns by ``gid``) goes to the summed pairs, not with their
    contexts: to every task up to NOTED samples, by joins beyond. Columns of ``notes`` are given twice, with ``_qry`` and ``_ref`` after their names.
    """
    c = F.col
    if conflicts:
        rows = checkpoint(sketch.groupBy("gid", "hctx").agg(F.collect_list("obj").alias("value"))).withColumns({"asks": F.lit(True), "answers": F.size("value") == 1})
        distance = lambda x: F.array_min(F.transform("own", lambda o: D.object_distance(o, x["value"][0])))
    else:
        rows = sketch.select("gid", "hctx", c("obj").alias("value"), F.lit(True).alias("asks"), F.lit(True).alias("answers"))
        distance = lambda x: D.object_distance(c("own"), x["value"])
    keep = lambda x: x["gid"] != c("qry") if others else x["gid"] < c("qry")
    lists = context_lists(rows, {"ref": lambda x: x["gid"], "d": lambda x: distance(x).cast("byte")}, keep)
    pairs = _summed(dealt_by_query(lists, rows).select("qry", F.inline(F.arrays_zip("ref", "d"))), ["qry", "ref"])
    known = rows.groupBy("gid").agg(F.count("*").alias("x_ctx"), F.sum(c("answers").cast("long")).alias("y_ctx"))
    known = checkpoint(known.join(notes, "gid") if notes is not None else known)
    names = [x for x in notes.columns if x != "gid"] if notes is not None else []
    side = lambda n, ctx: known.select(c("gid").alias(n), ctx, *[c(x).alias(f"{x}_{n}") for x in names])
    small = known.count() <= NOTED
    q, r = (F.broadcast(x) if small else x.hint("shuffle_hash") for x in (side("qry", "x_ctx"), side("ref", "y_ctx")))
    return _with_fractions(pairs.join(q, "qry").join(r, "ref"), [f"{x}_{n}" for n in ("qry", "ref") for x in names])


def triangle_features(sketch: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """``features`` of all pairs ref < qry of a sketch without conflicts, by lists of shared contexts (``list_features``)."""
    return list_features(sketch, notes)


def metric_columns(sketch_size: int) -> dict[str, Column]:
    c = F.col
    return {
        "mash": D.mash_distance(c("xny"), c("x_ctx"), c("y_ctx")),
        "aaf": D.containment_distance(c("xny"), c("x_ctx"), c("y_ctx")),
        "ctx-naive": D.naive_distance(c("xny"), c("n_diff_obj"), c("n_diff_section")),
        "ctx-moe": D.mixture_distance(c("xny"), c("n_diff_obj"), c("n_diff_section"), c("n_mut2"), sketch_size),
    }


def report(pairs: DataFrame, metric: str, sketch_size: int, af_cut: float = 0.5, ctx_cut: int = 3, ani_cut: float = 0.0, top: int | None = None) -> DataFrame:
    """Pairs that pass the cuts, with ``ani``, ranked per query by ani, fraction and reference; the first ``top`` of each if given.

    Both report paths of the identity cut are one here: ani must be at least the cut.
    """
    scored = pairs.withColumn("ani", 1 - D.metric_expression(metric, metric_columns(sketch_size)))
    scored = scored.withColumn("max_af", F.greatest("af_qry", "af_ref"))
    scored = scored.where((F.col("max_af") >= af_cut) & (F.col("xny") >= ctx_cut) & (F.col("ani") >= ani_cut))
    rank = F.row_number().over(Window.partitionBy("qry").orderBy(F.desc("ani"), F.desc("max_af"), "ref"))
    ranked = scored.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= top) if top else ranked


def edges(pairs: DataFrame, metric: str, sketch_size: int, cut: float, ctx_cut: int = 0, max_af: float = 0.0) -> DataFrame:
    scored = pairs.withColumn("distance", D.metric_expression(metric, metric_columns(sketch_size))).withColumn("max_af", F.greatest("af_qry", "af_ref"))
    return scored.where((F.col("distance") < cut) & (F.col("xny") >= ctx_cut) & (F.col("max_af") >= max_af)).select(F.col("qry").alias("a"), F.col("ref").alias("b"), "distance", "xny", "max_af")


def candidates(sketch: DataFrame, max_frequency: int = 0, min_votes: int = 1, step: int = 1) -> DataFrame:
    """``qry, ref, votes``: pairs nominated by shared contexts.

    Exact by default: every pair that shares a context. A vote index loses pairs by leaving out
    contexts that more than ``max_frequency`` samples have, or taking every ``step``-th context of a query only.
    """
    side = without_common(sketch, max_frequency) if max_frequency else sketch
    q = side.select(F.col("gid").alias("qry"), "hctx").distinct()
    if step > 1:
        at = F.row_number().over(Window.partitionBy("qry").orderBy("hctx")) - 1
        q = q.withColumn("_at", at).where(F.col("_at") % step == 0).drop("_at")
    r = side.select(F.col("gid").alias("ref"), "hctx").distinct()
    return q.join(r, "hctx").where("ref < qry").groupBy("qry", "ref").agg(F.count("*").alias("votes")).where(F.col("votes") >= min_votes)


def verified(nominated: DataFrame, sketch: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Exact features of nominated pairs ``qry, ref`` from all their contexts, also those that the nomination left out.

    The work follows the nominated pairs and their sketches, not the frequencies of contexts.
    """
    pairs = nominated.select("qry", "ref").distinct()
    q = sketch.select(F.col("gid").alias("qry"), "hctx", F.col("obj").alias("_q"))
    r = sketch.select(F.col("gid").alias("ref"), "hctx", F.col("obj").alias("_r"))
    joined = pairs.join(q, "qry").join(r, ["ref", "hctx"])
    return features(joined.select("qry", "ref", "hctx", D.object_distance(F.col("_q"), F.col("_r")).alias("d")), context_counts(sketch) if counts is None else counts)


#: Samples of a block of columns of a full matrix.
BLOCK_COLUMNS = 4096


def full_matrix(pairs: DataFrame, samples: DataFrame, distance: Column, diagonal: float = 0.0, missing: float = 1.0) -> DataFrame:
    """``row, col, distance`` of every ordered pair of samples, for presentation of small sets: triangle pairs mirrored, others ``missing``.

    The size is that of the printed matrix, but no cell is shuffled, sorted or held. Pairs are mirrored as they are. Of every row and block of
    columns, the columns that no pair has are the block's ids without the listed ones. What is dealt are pairs, and a row per row and block;
    the samples' ids go to every task, as in any product.
    """
    c, ids = F.col, samples.select("gid").distinct()
    placed = checkpoint(with_place(ids, [c("gid")], "_at").select("gid", F.floor((c("_at") - 1) / BLOCK_COLUMNS).alias("_block")))
    cell = lambda row, col: F.struct(c(row).alias("row"), c(col).alias("col"), c("distance"))
    half = pairs.where("qry <> ref").select("qry", "ref", distance.alias("distance"))
    both = half.select(F.explode(F.array(cell("qry", "ref"), cell("ref", "qry"))).alias("c")).select("c.*")
    both = both.join(F.broadcast(placed.select(c("gid").alias("row"))), "row", "left_semi").join(F.broadcast(placed.select(c("gid").alias("col"), "_block")), "col")
    blocks = placed.groupBy("_block").agg(F.collect_list("gid").alias("_ids"))  # of a fixed size each
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = both.select("row", "_block", "col")
    own = placed.select(c("gid").alias("row"), "_block", c("gid").alias("col"))
    grid = placed.select(c("gid").alias("row")).join(blocks.select("_block")).select("row", "_block", F.lit(None).cast("long").alias("col"))
    present = grid.union(listed).union(own).repartition(n, "row").groupBy("row", "_block").agg(F.collect_list("col").alias("_present"))
    empty = present.join(F.broadcast(blocks), "_block").select("row", F.explode(F.array_except("_ids", "_present")).alias("col"), F.lit(float(missing)).alias("distance"))
    diagonals = placed.select(c("gid").alias("row"), c("gid").alias("col"), F.lit(float(diagonal)).alias("distance"))
    return both.select("row", "col", F.coalesce("distance", F.lit(float(missing))).alias("distance")).union(diagonals).union(empty)


def pivoted(matrix: DataFrame, names: list[int]) -> DataFrame:
    return matrix.groupBy("row").pivot("col", names).agg(F.first("distance"))
