"""Calibrated species calls: joined features, gates and abundance rules.

Rows of a unique and a split profile (one per reference, with its taxid) are
reduced to one row per taxid and joined. Gates first reduce the table to a few
scalars, then decide every row by an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlake.operators.order import with_running_sum

MEASURES = ("ani", "xny", "min_af", "breadth", "mean_depth", "hit_mean_depth", "depth_cv", "normalized_depth", "latent_af", "latent_ani")
#: Fixed values of the gates.
TAIL_UAF, TAIL_PROBABILITY = 0.35, 0.25
LOW_EXTRA_UAF, LOW_EXTRA_PROBABILITY = 0.45, 0.20
SPARSE_BREADTH, SPARSE_RATIO = 0.15, 200.0
FILTER_MEDIAN, FILTER_MIN = 253.0, 25.0


def per_taxid(rows: DataFrame, prefix: str) -> DataFrame:
    """Maxima of all measures per taxid (of the depth variation also the minimum), the number of rows, and call flags."""
    direct = (F.col("xny") >= 10) & (F.col("ani") >= 0.95) & (F.col("min_af") >= 0.05)
    out = [F.count("*").alias(f"{prefix}_rows"), F.max(direct.cast("int")).alias(f"{prefix}_direct")]
    out += [F.max(F.col(m).cast("double")).alias(f"{prefix}_{m}") for m in MEASURES]
    out += [F.min(F.col("depth_cv").cast("double")).alias(f"{prefix}_depth_cv_min")]
    return rows.groupBy("taxid").agg(*out)


def joined(unique: DataFrame, split: DataFrame) -> DataFrame:
    """Both profiles by taxid; what is missing counts as 0; ratios over nothing are 0."""
    both = per_taxid(unique, "u").join(per_taxid(split, "s"), "taxid", "full_outer")
    both = both.select("taxid", *[F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0)).alias(c) if t == "double" else F.coalesce(F.col(c), F.lit(0)).alias(c) for c, t in both.dtypes if c != "taxid"])
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return both.withColumns({"xny_ratio": ratio("s_xny", "u_xny"), "breadth_ratio": ratio("s_breadth", "u_breadth"), "ani_delta": F.col("s_ani") - F.col("u_ani")})


def genus(name: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(name, r"[\[\]]", "")), r"\s+")
    return F.when((words[0] == "Candidatus") & (F.size(words) > 1), words[1]).otherwise(F.coalesce(words[0], F.lit("")))


def _top(frame: DataFrame, mask: Column, score: Column, n: int, name: str) -> DataFrame:
    """Marks the n best rows of each genus among those of the mask; ties go to the smaller taxid."""
    place = F.row_number().over(Window.partitionBy("genus", "_mask").orderBy(F.desc("_score"), "taxid"))
    return frame.withColumn("_mask", mask).withColumn("_score", score).withColumn(name, F.col("_mask") & (place <= n)).drop("_mask", "_score")


def adaptive_gate(features: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Features (with ``probability`` and ``name``) plus ``called`` and ``mode``, by the adaptive gate around an identity of 0.95."""
    c = F.col
    base = (c("u_xny") >= 10) & (c("u_ani") >= 0.95) & (c("u_min_af") >= 0.05)
    gate = c("probability") >= threshold
    strict = (c("s_xny") >= 50) & (c("s_ani") >= 0.95) & (c("s_min_af") >= 0.05) & (c("s_breadth") >= 0.05)
    near_unique = strict & (c("u_xny") >= 50) & (c("u_ani") >= 0.93)
    score = c("s_xny") * F.greatest(c("s_breadth"), F.lit(1e-6)) * F.greatest(c("s_ani"), F.lit(0.0)) * F.greatest(c("probability"), F.lit(0.01))
    rows = features.withColumns({"genus": genus(c("name")), "base": base, "gate": gate, "strict": strict, "near_unique": near_unique})
    number = lambda x: F.sum(x.cast("int")).cast("double")
    mass = lambda x: F.coalesce(F.sum(F.when(x, c("s_normalized_depth"))), F.lit(0.0))
    scalars = rows.agg(
        mass(c("base")).alias("base_mass"), mass(c("gate") & ~c("base")).alias("extra_mass"), number(c("base")).alias("n_base"), number(c("gate")).alias("n_gate"),
        F.coalesce(F.median(F.when(c("base"), c("u_min_af"))), F.lit(0.0)).alias("uaf"),
    )
    rows = rows.join(F.broadcast(scalars))  # one row
    rows = rows.withColumn("mass_ratio", c("extra_mass") / (c("base_mass") + 1e-12)).withColumn("count_ratio", c("n_gate") / F.greatest(c("n_base"), F.lit(1.0)))
    rows = _top(rows, c("gate") & c("strict") & ~c("base"), score, 2, "rescue")
    rows = _top(rows, (c("probability") >= LOW_EXTRA_PROBABILITY) & c("strict") & ~c("base"), score, 1, "low_extra")
    low = c("mass_ratio") < 0.005
    rescued = low & (c("uaf") < LOW_EXTRA_UAF)
    high = (c("mass_ratio") >= 0.20) & (c("count_ratio") >= 1.20)
    tail = high & (c("uaf") < TAIL_UAF)
    plain = (c("n_gate") <= c("n_base")) & (c("mass_ratio") < 0.03)
    adaptive = (
        F.when(rescued, c("base") | c("low_extra")).when(low, c("base")).when(tail, c("probability") >= TAIL_PROBABILITY).when(high, c("base") | c("rescue")).when(plain, c("base") | c("near_unique")).otherwise(c("gate"))
    )
    any_low_extra = rows.agg(F.coalesce(F.max("low_extra"), F.lit(False)).alias("any_low_extra"))
    rows = rows.join(F.broadcast(any_low_extra))
    mode = F.when(rescued & c("any_low_extra"), "base_low_extra_split_rescue").when(low, "base").when(tail, "probability_high_extra_low_uaf_tail025").when(high, "rescue").when(plain, "strict_plain").otherwise("probability")
    rows = rows.withColumn("adaptive", adaptive).withColumn("mode", mode).withColumn("tail_added", tail & (c("probability") >= TAIL_PROBABILITY) & ~(c("base") | c("rescue")))
    near = (c("s_xny") >= 300) & (c("s_ani") >= 0.948) & (c("s_ani") < 0.9505) & (c("s_min_af") >= 0.05) & (c("s_breadth") >= 0.20) & (c("s_hit_mean_depth") >= 1.4) & (c("probability") >= 0.20) & (c("u_ani") >= 0.92) & ~c("adaptive")
    rows = _top(rows, near, c("probability") * c("s_xny") * F.greatest(c("s_breadth"), F.lit(1e-6)) * F.greatest(c("s_hit_mean_depth"), F.lit(1.0)), 1, "near95")
    keep = [*features.columns, "genus", "mode", "tail_added"]
    return rows.select(*keep, (c("adaptive") | c("near95")).alias("called"))


def panel_abundance() -> Column:
    """The larger of split and unique mean depth over latent fraction; the split mean depth for tail rescues."""
    over = lambda p: F.col(f"{p}_mean_depth") / F.greatest(F.col(f"{p}_latent_af"), F.lit(1e-6))
    return F.when(F.col("tail_added"), F.col("s_mean_depth")).otherwise(F.greatest(over("s"), over("u")))


def exact_hit_abundance(fallback: Column) -> Column:
    return F.when(F.col("s_hit_mean_depth") > 0, F.col("s_hit_mean_depth")).otherwise(fallback)


def adaptive_filter(rows: DataFrame, median: float = FILTER_MEDIAN, least: float = FILTER_MIN) -> DataFrame:
    """Calls that survive the support filter: it acts only if the median support of the calls is ``median`` or more, on those with less than ``least``."""
    s, u = F.col("s_xny"), F.col("u_xny")
    held = F.when((s > 0) & (u > 0), F.least(s, u)).otherwise(F.greatest(s, u))
    middle = rows.where("called").agg(F.coalesce(F.median(F.greatest("s_xny", "u_xny").cast("double")), F.lit(0.0)).alias("_median"))
    return rows.join(F.broadcast(middle)).withColumn("called", F.col("called") & ((F.col("_median") < median) | (held >= least))).drop("_median")


def reported_ani() -> Column:
    return F.when((F.col("s_latent_ani") <= 0) & (F.col("u_latent_ani") > 0), F.col("u_latent_ani")).otherwise(F.col("s_latent_ani"))


def ani_floor(raw: Column, floor: float) -> Column:
    return F.when(F.col("called") & (raw > 0) & (reported_ani() < floor), F.lit(0.0)).otherwise(F.greatest(raw, F.lit(0.0)))


def sparse_depth_cap(raw: Column, breadth_max: float = SPARSE_BREADTH, ratio_min: float = SPARSE_RATIO) -> Column:
    breadth = F.least(F.greatest(F.col("s_breadth"), F.col("u_breadth"), F.lit(0.0)), F.lit(1 - 1e-12))
    poisson = -F.log1p(-breadth)
    capped = F.col("called") & (raw > 0) & (breadth <= breadth_max) & (raw / F.greatest(poisson, F.lit(1e-12)) >= ratio_min)
    return F.when(capped, F.least(raw, poisson)).otherwise(F.greatest(raw, F.lit(0.0)))


def genus_blend(rows: DataFrame, raw: str, alpha: float) -> DataFrame:
    """``blended``: within each genus of two or more called rows, alpha of the mass goes by shared contexts."""
    active = F.col("called") & (F.col(raw) > 0)
    quality = F.least(F.greatest(F.col("s_xny") / F.lit(1000.0), F.lit(0.0)), F.lit(1.0))
    by = Window.partitionBy("genus", "_active")
    rows = rows.withColumn("_active", active).withColumn("_weighted", F.col(raw) * quality)
    n, total, weighted = F.count("*").over(by), F.sum(raw).over(by), F.sum("_weighted").over(by)
    rows = rows.withColumn("_n", n).withColumn("_total", total).withColumn("_sum", weighted)
    moved = (1 - alpha) * F.col(raw) + alpha * F.col("_weighted") / F.col("_sum") * F.col("_total")
    blended = F.when(F.col("_active") & (F.col("_n") > 1) & (F.col("_sum") > 0), moved).otherwise(F.greatest(F.col(raw), F.lit(0.0)))
    return rows.withColumn("blended", blended).drop("_active", "_weighted", "_n", "_total", "_sum")


def presence_scores(predicted: DataFrame, truth: DataFrame, key: str = "taxid") -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1 of two key sets."""
    p = predicted.select(key).distinct().withColumn("p", F.lit(1))
    t = truth.select(key).distinct().withColumn("t", F.lit(1))
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    both = p.join(t, key, "full_outer").agg(n(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), n(F.col("t").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return both.select("tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mean absolute and squared error, distance, and linear and rank correlation (ties share their mean rank) of two columns.

    Ranks come from cumulated counts of distinct values.
    """

    def ranks(column: str, name: str) -> DataFrame:
        counted = rows.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_k"))
        return with_running_sum(counted, [F.col("_v")], "_k", "_upto").select("_v", (F.col("_upto") - (F.col("_k") - 1) / 2).alias(name))

    ranked = rows.join(ranks(a, "_ra").withColumnRenamed("_v", "_va"), F.col(a) == F.col("_va")).join(ranks(b, "_rb").withColumnRenamed("_v", "_vb"), F.col(b) == F.col("_vb"))
    gap = F.col(a) - F.col(b)
    return ranked.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.sum(F.abs(gap)).alias("l1"), F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


def ambiguity_em(edges: DataFrame, marker: DataFrame, alpha: float = 1.0, power: float = 1.0, iterations: int = 30, every: int = 5) -> DataFrame:
    """``gid, share``: expectation-maximisation of shares over ambiguous (unit, hctx) groups, from marker shares.

    A candidate's weight is its share to ``power`` times exp(-alpha (d - best)). Each
    round is a sum per group and one per reference, which is written.
    """
    from sketchlake.session import checkpoint

    prior = marker.select("gid", F.greatest("share", F.lit(1e-12)).alias("share"))
    whole = prior.agg(F.sum("share").alias("w"))
    state = checkpoint(prior.join(F.broadcast(whole)).select("gid", (F.col("share") / F.col("w")).alias("share")))
    rows = edges.join(state.select("gid"), "gid", "left_semi").select("unit", "hctx", "gid", F.exp(-alpha * F.greatest(F.col("d") - F.col("best"), F.lit(0))).alias("likelihood"))
    rows = checkpoint(rows)
    if rows.isEmpty():
        return state
    whole = F.sum("w").over(Window.partitionBy("unit", "hctx"))
    for i in range(iterations):
        weighted = rows.join(state, "gid").select("unit", "hctx", "gid", (F.pow("share", F.lit(power)) * F.col("likelihood")).alias("w"))
        counted = weighted.withColumn("whole", whole).where("whole > 0").groupBy("gid").agg(F.sum(F.col("w") / F.col("whole")).alias("n"))
        counted = checkpoint(counted)  # a row per reference; read for the total and for the shares
        total = counted.agg(F.sum("n").alias("total"))
        state = state.select("gid").join(counted, "gid", "left").join(F.broadcast(total)).select("gid", (F.coalesce("n", F.lit(0.0)) / F.col("total")).alias("share"))
        if (i + 1) % every == 0 or i + 1 == iterations:
            state = checkpoint(state)
    return state


def context_em(reads: DataFrame, ref: DataFrame, marker: DataFrame, alpha: float = 1.0, power: float = 1.0, iterations: int = 30, every: int = 5) -> DataFrame:
    """``ambiguity_em`` of the candidates of reads, which are many times the reads, without writing, sorting or dealing them.

    What is written are classes of reads and the references' entries. A round sends each entry's share to its context, joins the classes there
    twice (for the sum of each class, then for the parts of it), and what leaves a task is a sum per reference.
    """
    from sketchlake.operators import readwise as R
    from sketchlake.session import checkpoint

    c, n = F.col, int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prior = marker.select("gid", F.greatest("share", F.lit(1e-12)).alias("share"))
    whole = prior.agg(F.sum("share").alias("w"))
    state = checkpoint(prior.join(F.broadcast(whole)).select("gid", (c("share") / c("w")).alias("share")))
    found, refs = R.classes(reads, ref)
    refs = refs.where("n_candidates > 1").select("hctx", "gid", "_r")
    d = R._nearest(c("_q"), c("_r"))
    found = checkpoint(found.join(refs, "hctx").select("hctx", "_q", "n_units", d.alias("d")).groupBy("hctx", "_q", "n_units").agg(F.min("d").alias("best")))
    if found.isEmpty():
        return state
    entries = checkpoint(refs.repartition(n, "gid"))
    w = (F.pow("share", F.lit(power)) * F.exp(-alpha * (d - c("best")))).alias("w")
    for i in range(iterations):
        shares = entries.join(state, "gid").repartition(n, "hctx")
        summed = found.join(shares, "hctx").select("hctx", "_q", "n_units", "best", w).groupBy("hctx", "_q", "n_units", "best").agg(F.sum("w").alias("whole")).where("whole > 0")
        parts = summed.join(shares, "hctx").select("gid", (c("n_units") * w / c("whole")).alias("n"))
        counted = checkpoint(parts.groupBy("gid").agg(F.sum("n").alias("n")))  # a row per reference; read for the total and for the shares
        total = counted.agg(F.sum("n").alias("total"))
        state = state.select("gid").join(counted, "gid", "left").join(F.broadcast(total)).select("gid", (F.coalesce("n", F.lit(0.0)) / c("total")).alias("share"))
        if (i + 1) % every == 0 or i + 1 == iterations:
            state = checkpoint(state)
    return state


def threshold_grid(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold of a given grid, from one pass that counts rows per grid cell."""
    cell = F.size(F.filter(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]), lambda t: t <= F.col(score)))
    counted = rows.groupBy(cell.alias("cell")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    grid = rows.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(sorted(thresholds))], "at int, threshold double")
    whole = counted.agg(F.sum("pos").alias("all_pos"))
    met = grid.join(F.broadcast(counted), F.col("cell") >= F.col("at"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("called"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, called, every = F.col("tp"), F.col("called"), F.col("all_pos")
    return met.join(F.broadcast(whole)).select("threshold", "tp", "called", safe(tp, called).alias("precision"), safe(tp, every).alias("recall"), safe(2 * tp, called + every).alias("f1"))


#: Fixed values of candidate rescue (emitted and split evidence), the allocator's guards and the exact-pass triggers.
RESCUE_EMITTED = {"latent_ani": 0.90, "xny": 100.0, "breadth": 0.01, "min_af": 0.70}
RESCUE_SPLIT = {"s_xny": 300.0, "s_ani": 0.95, "s_min_af": 0.60, "s_breadth": 0.25, "s_mean_depth": 1.0}
RESCUE_SPLIT_PROBABILITY = 0.02
ALLOCATOR_ALPHA, ALLOCATOR_MULTI_GENUS, ALLOCATOR_XNY = 0.02, 0.37501510201405147, 230.3
EXACT_CALL_TRIGGER, EXACT_ABUNDANCE_TRIGGER = 0.10, 0.30


def candidate_rescue(rows: DataFrame, mode: str, alpha: float = 2.0, cuts: dict[str, float] | None = None) -> DataFrame:
    """Rows (with ``called``, ``genus``) plus ``rescued`` and ``rescue_mass``, and calls that include the rescued.

    ``emitted`` adds uncalled species with enough evidence in either profile; their own mass is
    dropped and ``alpha`` times the larger normalised depth takes its place. ``split`` adds the
    best of each genus among those with strict split evidence; they keep their mass. ``cuts`` override the fixed ones by name.
    """
    c = F.col
    if mode == "emitted":
        enough = F.lit(True)
        for measure, cut in (RESCUE_EMITTED | (cuts or {})).items():
            enough = enough & (F.greatest(f"s_{measure}", f"u_{measure}") >= cut)
        out = rows.withColumn("rescued", ~c("called") & enough)
        mass = F.when(c("rescued"), alpha * F.greatest("s_normalized_depth", "u_normalized_depth")).otherwise(F.lit(0.0))
    elif mode == "split":
        enough = F.lit(True)
        for measure, cut in ({"probability": RESCUE_SPLIT_PROBABILITY} | RESCUE_SPLIT | (cuts or {})).items():
            enough = enough & (c(measure) >= cut)
        score = F.greatest("s_mean_depth", F.lit(0.0)) * F.greatest("s_breadth", F.lit(1e-6)) * F.greatest("s_ani", F.lit(0.0)) * F.greatest("s_xny", F.lit(1.0))
        out = _top(rows, ~c("called") & enough, score, 1, "rescued")
        mass = F.lit(0.0)
    else:
        raise ValueError(f"emitted or split: {mode!r}")
    return out.withColumn("rescue_mass", mass).withColumn("called", c("called") | c("rescued"))


def guarded_allocator(rows: DataFrame, raw: str, guard_xny: bool = False) -> DataFrame:
    """``allocated``: in genera of two or more eligible rows a small part of the mass goes by mass times depth of hits times breadth.

    It acts only if enough of the called mass lies in such genera (and, if asked, the
    calls' median support is large). Rescued rows keep their mass.
    """
    c = F.col
    rescued = c("rescued") if "rescued" in rows.columns else F.lit(False)
    rows = rows.withColumn("_on", c("called") & (c(raw) > 0)).withColumn("_eligible", c("_on") & ~rescued)
    rows = rows.withColumn("_many", F.count("*").over(Window.partitionBy("genus", "_on")) > 1)
    mass = lambda x: F.coalesce(F.sum(F.when(x, c(raw))), F.lit(0.0))
    guard = rows.agg(mass(c("_on")).alias("_all"), mass(c("_on") & c("_many")).alias("_multi"), F.coalesce(F.median(F.when(c("called"), c("s_xny").cast("double"))), F.lit(0.0)).alias("_xny"))
    passed = (c("_all") > 0) & (c("_multi") / c("_all") >= ALLOCATOR_MULTI_GENUS)
    if guard_xny:
        passed = passed & (c("_xny") >= ALLOCATOR_XNY)
    rows = rows.join(F.broadcast(guard))  # one row
    by = Window.partitionBy("genus", "_eligible")
    quality = F.greatest(c("s_hit_mean_depth") * c("s_breadth"), c("u_hit_mean_depth") * c("u_breadth"))
    rows = rows.withColumn("_w", c(raw) * quality)
    total, weighted, n = F.sum(raw).over(by), F.sum("_w").over(by), F.count("*").over(by)
    moved = (1 - ALLOCATOR_ALPHA) * c(raw) + ALLOCATOR_ALPHA * c("_w") / weighted * total
    out = rows.withColumn("allocated", F.when(passed & c("_eligible") & (n > 1) & (weighted > 0), moved).otherwise(F.greatest(c(raw), F.lit(0.0))))
    return out.drop("_on", "_eligible", "_many", "_all", "_multi", "_xny", "_w")


def exact_pass_decision(gated: DataFrame, for_abundance: bool) -> DataFrame:
    """One row: whether the extra share of probability calls asks for the exact pass (low for calls, high for abundance)."""
    base = (F.col("u_xny") >= 10) & (F.col("u_ani") >= 0.95) & (F.col("u_min_af") >= 0.05)
    extra = F.sum((~base & F.col("called")).cast("double")) / F.greatest(F.sum(F.col("called").cast("double")), F.lit(1.0))
    share = gated.agg(F.coalesce(extra, F.lit(0.0)).alias("extra"))
    return share.select("extra", (F.col("extra") >= EXACT_ABUNDANCE_TRIGGER if for_abundance else F.col("extra") <= EXACT_CALL_TRIGGER).alias("rerun"))
