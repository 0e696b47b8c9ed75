"""Read profiling: best-match assignment, coverage, depth, context filters, calls and tracking.

Reads are units of entries ``unit, hctx, obj``; the reference is a sketch. The
join on contexts gives candidates; everything after is grouped aggregation, and
the coverage table (one row per reference context that was hit) is the narrow
waist that all profiles share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlake.functions import distance as D
from sketchlake.session import ship

MODES = ("all", "best-diff", "best-diff-unique", "best-diff-split")
#: Split increments are in 1/1024, coverage saturates at 2**28 - 1, stored differences at 14.
SPLIT_SCALE, COVERAGE_MAX, DIFF_MAX = 1024, (1 << 28) - 1, 14


def candidates(reads: DataFrame, ref: DataFrame, ignore_conflicts: bool = False) -> DataFrame:
    """``unit, hctx, gid, d``: references of each context of a unit, with the smallest object distance."""
    if ignore_conflicts:
        single = ref.groupBy("gid", "hctx").agg(F.count("*").alias("n"), F.first("obj").alias("obj")).where("n = 1")
        ref = single.select("gid", "hctx", "obj")
    q = reads.select("unit", "hctx", F.col("obj").alias("_q")).distinct()
    r = ref.select("gid", "hctx", F.col("obj").alias("_r"))
    return q.join(r, "hctx").groupBy("unit", "hctx", "gid").agg(F.min(D.object_distance(F.col("_q"), F.col("_r"))).alias("d"))


def assign(found: DataFrame, mode: str) -> DataFrame:
    """The candidates that a mode selects, with ``best``, ``n_best``, ``n_candidates`` and the coverage increment ``inc``."""
    if mode not in MODES:
        raise ValueError(f"one of {MODES}: {mode!r}")
    by = Window.partitionBy("unit", "hctx")
    marked = found.withColumn("best", F.min("d").over(by)).withColumn("n_candidates", F.count("*").over(by))
    marked = marked.withColumn("n_best", F.sum((F.col("d") == F.col("best")).cast("long")).over(by))
    inc = F.lit(1).cast("long")
    if mode == "all":
        return marked.withColumn("inc", inc)
    chosen = marked.where(F.col("d") == F.col("best"))
    if mode == "best-diff-unique":
        chosen = chosen.where("n_best = 1")
    if mode == "best-diff-split":
        inc = F.floor((F.lit(SPLIT_SCALE) + F.floor(F.col("n_best") / 2)) / F.col("n_best"))
    return chosen.withColumn("inc", inc)


#: Contexts of references that a task of the matching meets with their reads, about.
TASK_CONTEXTS = 1 << 15


def _tasks(ref: DataFrame) -> int:
    """As many tasks as are set, or more where the references ask for it.

    Merged by the size of the reads, which the join multiplies, tasks would be too large, and a number that stays as tables grow has them spill. ``ref`` is counted, so it should be written.
    """
    return max(int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ref.count() // TASK_CONTEXTS))


def _sides(reads: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join on contexts, each dealt by context once.

    Of reads: ``unit, hctx, _q``, their objects in each context that a reference has. Of references: ``hctx, gid, _r, n_candidates, place``.
    Every reference of a context is a candidate of every read with it, so the candidates' number and order are known before the join.
    """
    by = Window.partitionBy("hctx")
    n = _tasks(ref)
    refs = ref.select("hctx", "gid", "obj").repartition(n, "hctx").groupBy("hctx", "gid").agg(F.collect_set("obj").alias("_r"))
    refs = refs.select("hctx", "gid", "_r", F.count("*").over(by).alias("n_candidates"), (F.row_number().over(by.orderBy("gid")) - 1).cast("long").alias("place"))
    found = reads.select("unit", "hctx", "obj").repartition(n, "hctx").join(refs.select("hctx").distinct(), "hctx", "left_semi")
    return found.groupBy("unit", "hctx").agg(F.collect_set("obj").alias("_q")), refs


def _nearest(q: Column, r: Column) -> Column:
    """The smallest distance of two lists of objects, which mostly have one object each."""
    single = (F.size(q) == 1) & (F.size(r) == 1)
    every = F.array_min(F.transform(q, lambda x: F.array_min(F.transform(r, lambda y: D.object_distance(x, y)))))
    return F.when(single, D.object_distance(F.element_at(q, 1), F.element_at(r, 1))).otherwise(every)


#: Candidates of a context are fewer than two to this power.
COUNT_BITS = 40


def hits(reads: DataFrame, ref: DataFrame) -> DataFrame:
    """``unit, hctx``: the reads' contexts that a reference has, without their candidates."""
    return _sides(reads, ref)[0].select("unit", "hctx")


def matched(reads: DataFrame, ref: DataFrame, mode: str, marked: bool = True) -> DataFrame:
    """What ``assign`` makes of the reads' candidates, and the ``place`` of each by reference, without sorting or holding them.

    The candidates are many times the reads. So they are joined twice, by context, and never kept: first only the numbers of each distance are
    summed per unit and context, which gives ``best`` and ``n_best``; then rows that the mode selects are passed on. Both joins, and sums per
    context after them, need no further shuffle. With ``marked`` false (mode "all" only), ``best`` and ``n_best`` are left out.
    """
    return _selected(*_sides(reads, ref), mode, "unit", marked)


def _selected(found: DataFrame, refs: DataFrame, mode: str, key: str, marked: bool = True) -> DataFrame:
    """``matched`` of both sides; ``key`` tells the rows of a context apart beside their objects."""
    if mode not in MODES:
        raise ValueError(f"one of {MODES}: {mode!r}")
    c = F.col
    d = _nearest(c("_q"), c("_r")).alias("d")
    one = F.lit(1).cast("long")
    if mode == "all" and not marked:
        return found.join(refs, "hctx").select(key, "hctx", "gid", d, "n_candidates", "place", one.alias("inc"))
    counted = found.join(refs, "hctx").select(key, "hctx", "_q", d).groupBy(key, "hctx", "_q", "d").agg(F.count("*").alias("_n"))
    first = F.min(F.shiftleft(c("d").cast("long"), COUNT_BITS).bitwiseOR(c("_n"))).alias("_first")
    nearest = counted.groupBy(key, "hctx", "_q").agg(first).select(key, "hctx", "_q", F.shiftright("_first", COUNT_BITS).cast("int").alias("best"), c("_first").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).alias("n_best"))
    if mode == "best-diff-unique":
        nearest = nearest.where("n_best = 1")
    rows = nearest.join(refs, "hctx").select(key, "hctx", "gid", d, "best", "n_candidates", "n_best", "place")
    inc = F.floor((F.lit(SPLIT_SCALE) + F.floor(c("n_best") / 2)) / c("n_best")) if mode == "best-diff-split" else one
    return (rows if mode == "all" else rows.where("d = best")).withColumn("inc", inc)


def classes(reads: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hctx, _q, n_units``: the reads' objects in each context that a reference has, with the number of units that have them; and the side of references.

    Units with the same objects in a context have the same candidates at the same distances. Both are dealt by context.
    """
    found, refs = _sides(reads, ref)
    return found.groupBy("hctx", F.sort_array("_q").alias("_q")).agg(F.count("*").alias("n_units")), refs


def covered(reads: DataFrame, ref: DataFrame, mode: str) -> DataFrame:
    """``coverage`` of ``matched``, from classes of reads: no unit meets its candidates by itself."""
    rows = _selected(*classes(reads, ref), mode, "n_units")
    return coverage(rows.withColumn("_times", F.col("n_units")))


def coverage(assigned: DataFrame) -> DataFrame:
    """Per reference context: saturated coverage, smallest difference, and the largest single increment. Rows may stand for several (``_times``)."""
    increments = F.col("inc") * F.col("_times") if "_times" in assigned.columns else F.col("inc")
    return assigned.groupBy("gid", "hctx").agg(
        F.least(F.sum(increments), F.lit(COVERAGE_MAX)).alias("cov"), F.least(F.min("d"), F.lit(DIFF_MAX)).cast("int").alias("diff"), F.max("inc").alias("weight")
    )


def support(assigned: DataFrame) -> DataFrame:
    """Per reference: assignments, units, and how many of its and the reads' contexts were hit.

    Assignments are summed per reference and context first, which reads dealt by context do in place; units are told apart dealt by unit.
    """
    diff = F.col("d").cast("long")
    per = assigned.groupBy("gid", "hctx").agg(F.count("*").alias("_n"), F.sum((diff > 0).cast("long")).alias("_diff"), F.sum(diff).alias("_section"), F.sum((diff > 1).cast("long")).alias("_mut2"))
    sums = per.groupBy("gid").agg(F.sum("_n").alias("hits"), F.count("*").alias("ctx_hit"), F.sum("_diff").alias("hits_diff"), F.sum("_section").alias("hits_section"), F.sum("_mut2").alias("hits_mut2"))
    units = assigned.select("unit", "gid").repartition(int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit").distinct().groupBy("gid").agg(F.count("*").alias("units"))
    return sums.join(units, "gid").select("gid", "hits", "units", "ctx_hit", "hits_diff", "hits_section", "hits_mut2")


def marker_contexts(ref: DataFrame) -> DataFrame:
    return ref.groupBy("hctx").agg(F.min("gid").alias("a"), F.max("gid").alias("b")).where("a = b").select("hctx")


def features(cov: DataFrame) -> DataFrame:
    """Best-difference features of the covered contexts of each reference."""
    d = F.col("diff")
    return cov.where("cov > 0").groupBy("gid").agg(
        F.count("*").alias("xny"), F.sum((d > 0).cast("long")).alias("n_diff_obj"), F.sum(d.cast("long")).alias("n_diff_section"), F.sum((d > 1).cast("long")).alias("n_mut2")
    )


def totals(ref: DataFrame) -> DataFrame:
    return ref.groupBy("gid").agg(F.count_distinct("hctx").alias("total"))


def depth(cov: DataFrame, total: DataFrame, scale: int = 1) -> DataFrame:
    """Breadth, depths, variation and relative depth of every reference, over all of its contexts."""
    c = F.col("cov") / F.lit(float(scale))
    sums = cov.groupBy("gid").agg(F.sum(c).alias("s"), F.sum(c * c).alias("q"), F.sum(F.least(F.col("weight") / F.lit(float(scale)), F.lit(1.0))).alias("hit"))
    rows = total.join(sums, "gid", "left").fillna(0.0, ["s", "q", "hit"])
    mean = F.col("s") / F.col("total")
    rows = rows.withColumn("mean_depth", mean).withColumn("variance", F.greatest(F.col("q") / F.col("total") - mean * mean, F.lit(0.0)))
    whole = rows.agg(F.sum("mean_depth").alias("whole"))  # one row
    rows = rows.join(F.broadcast(whole))
    zero = F.lit(0.0)
    return rows.select(
        "gid", "total", (F.col("hit") / F.col("total")).alias("breadth"), "mean_depth", F.when(F.col("hit") > 0, F.col("s") / F.col("hit")).otherwise(zero).alias("hit_mean_depth"),
        "variance", F.when(F.col("mean_depth") > 0, F.sqrt("variance") / F.col("mean_depth")).otherwise(zero).alias("depth_cv"),
        (1 - F.col("hit") / F.col("total")).alias("zero_fraction"), F.when(F.col("whole") > 0, F.col("mean_depth") / F.col("whole")).otherwise(zero).alias("relative_depth"),
    )


def _order_statistic(cov: DataFrame, value: Column, at: Column, name: str) -> DataFrame:
    """Per reference, the value at a rank (from 0) in ascending order; ``at`` may use the count ``n``. Values are reduced to a histogram first."""
    histogram = cov.where("cov > 0").groupBy("gid", value.alias("_v")).agg(F.count("*").alias("_k"))
    by = Window.partitionBy("gid")
    upto = F.sum("_k").over(by.orderBy("_v"))
    ranked = histogram.withColumn("_upto", upto).withColumn("n", F.sum("_k").over(by)).withColumn("_at", at)
    return ranked.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_k") <= F.col("_at"))).select("gid", F.col("_v").alias(name))


def top_fraction(cov: DataFrame, fraction: float, scale: int = 1, plus_one: bool = False) -> DataFrame:
    """``gid, threshold, median_diff, median_cov``: the product cut of the top fraction, and lower medians of difference and coverage.

    The product is difference (plus one if so told) times coverage; medians are the elements at (n - 1) / 2, never means.
    """
    fraction = min(max(fraction, 0.0), 1.0)
    depth_ = F.col("cov") / F.lit(float(scale))
    product = (F.col("diff") + (1 if plus_one else 0)) * depth_
    drop = F.least(F.greatest(F.ceil(F.col("n") * F.lit(fraction)), F.lit(1)), F.col("n"))
    middle = F.floor((F.col("n") - 1) / 2)
    out = _order_statistic(cov, product, F.col("n") - drop, "threshold")
    return out.join(_order_statistic(cov, F.col("diff"), middle, "median_diff"), "gid").join(_order_statistic(cov, depth_, middle, "median_cov"), "gid")


def filter_top_fraction(cov: DataFrame, fraction: float, scale: int = 1, median: bool = True, plus_one: bool = False) -> DataFrame:
    """Coverage whose suspicious contexts (product at or over the cut) are replaced by the reference's medians, or dropped.

    Adds ``adjusted``. Contexts without a difference are never suspicious, unless ``plus_one``.
    """
    joined = cov.where("cov > 0").join(top_fraction(cov, fraction, scale, plus_one), "gid")
    product = (F.col("diff") + (1 if plus_one else 0)) * (F.col("cov") / F.lit(float(scale)))
    hit = (product > 0) & (product >= F.col("threshold"))
    if not median:
        return joined.where(~hit | (F.col("diff") == 0)).select("gid", "hctx", "cov", "diff", "weight", F.lit(False).alias("adjusted"))
    return joined.select("gid", "hctx", F.when(hit, (F.col("median_cov") * scale).cast("long")).otherwise(F.col("cov")).alias("cov"), F.when(hit, F.col("median_diff")).otherwise(F.col("diff")).alias("diff"), "weight", hit.alias("adjusted"))


#: Counts beyond this have the largest tail score.
TAIL_LIMIT, TAIL_SCORE = 1024, 16.0
#: In extended precision, as tails down to 1e-16 are told from 1.
_LOG_FACTORIAL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, TAIL_LIMIT + 1, dtype=np.longdouble)))))


def _log_head(k: np.ndarray, log_pmf) -> np.ndarray:
    """log P(X < k) of each row, from log_pmf(row numbers, values), summed over all (row, value) cells of a slice at once."""
    out = np.empty(len(k), np.longdouble)
    for lo in range(0, len(k), 2048):
        n = k[lo : lo + 2048]
        row = np.repeat(np.arange(lo, lo + len(n)), n)
        first = np.cumsum(n) - n
        cells = log_pmf(row, np.arange(len(row)) - np.repeat(first, n))
        top = np.maximum.reduceat(cells, first)
        out[lo : lo + len(n)] = top + np.log(np.add.reduceat(np.exp(cells - np.repeat(top, n)), first))
    return np.minimum(out, 0.0)


def _by_distinct(columns: list[np.ndarray], score) -> np.ndarray:
    """``score`` of the distinct rows, dealt back to all."""
    rows, back = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
    return score(*rows.T)[back.ravel()]


def _poisson_score(k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    out = np.where(k > 0, TAIL_SCORE, 0.0)
    summed = (k > 0) & (k <= TAIL_LIMIT) & np.isfinite(rate) & (rate > 0)
    if summed.any():
        n, lam = k[summed].astype(np.int64), rate[summed].astype(np.longdouble)
        tail = -np.expm1(_log_head(n, lambda row, j: j * np.log(lam[row]) - lam[row] - _LOG_FACTORIAL[j]))
        out[summed] = np.where(tail > 1e-16, -np.log10(np.maximum(tail, 1e-16)), TAIL_SCORE)
    return out


def poisson_tail(k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """-log10 P(X >= k) of a Poisson; 0 for k = 0, at most 16, and 16 beyond k = 1024, without a rate or where the tail is lost in rounding."""
    return _by_distinct([np.asarray(k, float), np.asarray(rate, float)], _poisson_score)


def _negative_binomial_score(k: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    mean = np.where(np.isfinite(mean) & (mean > 0), mean, 1e-12)
    wide = np.isfinite(variance) & (variance > mean)
    size = mean * mean / np.where(wide, variance - mean, 1.0)
    p = size / (size + mean)
    wide &= (p > 0) & (p < 1)
    out = np.where(k > TAIL_LIMIT, TAIL_SCORE, _poisson_score(k, mean))
    summed = wide & (k > 0) & (k <= TAIL_LIMIT)
    if summed.any():
        n, r, chance = k[summed].astype(np.int64), size[summed].astype(np.longdouble), p[summed].astype(np.longdouble)
        log_p, log_q = np.log(chance), np.log1p(-chance)
        log_rising = np.cumsum(np.log1p((r[:, None] - 1) / np.arange(1, n.max() + 1)), 1) if n.max() * len(r) <= 1 << 22 else None
        if log_rising is None:  # a slice at a time
            half = len(r) // 2
            out[summed] = np.concatenate([_negative_binomial_score(k[summed][s], mean[summed][s], variance[summed][s]) for s in (slice(half), slice(half, None))])
            return out
        log_rising = np.concatenate((np.zeros((len(r), 1)), log_rising), 1)
        tail = -np.expm1(_log_head(n, lambda row, j: r[row] * log_p[row] + log_rising[row, j] + j * log_q[row]))
        positive = -np.expm1(r * log_p)
        given = np.where(positive > 0, tail / np.where(positive > 0, positive, 1.0), 2.0)
        out[summed] = np.where(tail > 1e-16, -np.log10(np.maximum(np.where((given > 0) & (given <= 1), given, tail), 1e-300)), TAIL_SCORE)
    return out


def negative_binomial_tail(k: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """-log10 P(X >= k | X > 0) of a negative binomial by moments; a Poisson where the variance isn't larger; 16 where the sum reaches 1."""
    return _by_distinct([np.asarray(c, float) for c in (k, mean, variance)], _negative_binomial_score)


def product_moments(cov: DataFrame, scale: int = 1) -> DataFrame:
    """Per reference: sum, mean and variance of the positive products without the largest one, and their number."""
    product = F.col("diff") * (F.col("cov") / F.lit(float(scale)))
    sums = cov.where((F.col("cov") > 0) & (F.col("diff") > 0)).groupBy("gid").agg(F.sum(product).alias("s"), F.sum(product * product).alias("q"), F.max(product).alias("m"), F.count("*").alias("n0"))
    many = F.col("n0") > 1
    n = F.when(many, F.col("n0") - 1).otherwise(F.col("n0"))
    s = F.greatest(F.when(many, F.col("s") - F.col("m")).otherwise(F.col("s")), F.lit(0.0))
    q = F.greatest(F.when(many, F.col("q") - F.col("m") * F.col("m")).otherwise(F.col("q")), F.lit(0.0))
    variance = F.when(n > 1, F.greatest(q - s * (s / n), F.lit(0.0)) / (n - 1)).otherwise(s / n)
    return sums.select("gid", n.alias("n"), s.alias("sum"), (s / n).alias("mean"), variance.alias("variance"))


def _reject_nb(threshold: float, scale: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            product = (rows["diff"] * rows["cov"] / scale).to_numpy(float)
            mean = rows["mean"].fillna(0.0).to_numpy(float)
            tested = (rows["diff"] > 0) & (rows["n"].fillna(0) >= least) & (mean > 0) & (product > mean)
            score = np.full(len(rows), -np.inf)
            at = np.flatnonzero(tested.to_numpy())
            score[at] = negative_binomial_tail(np.ceil(product[at]), mean[at], rows["variance"].to_numpy(float)[at])
            total = rows["total"].to_numpy(float)
            score -= np.where(total > 1, np.log10(np.maximum(total, 1)), 0.0)
            yield rows.assign(rejected=tested & (score >= threshold))[["gid", "hctx", "cov", "diff", "weight", "rejected"]]

    return run


def filter_product_nb(cov: DataFrame, total: DataFrame, threshold: float = 2.0, scale: int = 1, least: int = 10) -> DataFrame:
    """Coverage with ``rejected``: contexts whose product is too large for the reference's negative binomial, corrected for its contexts."""
    ship(cov.sparkSession)
    joined = cov.where("cov > 0").join(product_moments(cov, scale).select("gid", "n", "mean", "variance"), "gid", "left").join(total, "gid")
    return joined.mapInPandas(_reject_nb(threshold, scale, least), "gid long, hctx long, cov long, diff int, weight long, rejected boolean")


def fake_score(diff: Column, tail: Column, zero_fraction: Column, mean_depth: Column) -> Column:
    """Difference, depth surprise and pressure of a context, given its Poisson tail."""
    zero = F.least(F.greatest(F.when(F.isnan(zero_fraction), F.lit(0.0)).otherwise(zero_fraction), F.lit(1e-12)), F.lit(1 - 1e-12))
    rate = -F.log(zero)
    pressure = F.when((rate > 1e-12) & (mean_depth > 0), F.log1p(mean_depth / rate)).otherwise(F.lit(0.0))
    return diff + 0.30 * tail + 0.25 * pressure


def _score_contexts(threshold: float, scale: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            zero = np.clip(np.nan_to_num(rows["zero_fraction"].to_numpy(float)), 1e-12, 1 - 1e-12)
            rate, mean = -np.log(zero), rows["mean_depth"].to_numpy(float)
            lam = np.where(rate > 1e-12, rate, np.maximum(mean, 1e-12))
            depth_, diff = rows["cov"].to_numpy(float) / scale, rows["diff"].to_numpy(float)
            tail = poisson_tail(np.ceil(depth_), lam)
            score = diff + 0.30 * tail + 0.25 * np.where((rate > 1e-12) & (mean > 0), np.log1p(mean / rate), 0.0)
            total = rows["total"].to_numpy(float)
            correction = np.where(total > 1, np.log10(np.maximum(total, 1)), 0.0)
            product = diff * depth_
            expected = np.maximum(rows["product_sum"].fillna(0.0).to_numpy(float) / total, 1e-12)
            product_tail = poisson_tail(np.ceil(product), expected)
            x = np.clip(score - threshold, -40, 40)
            yield rows.assign(
                score=score,
                fake_probability=1 / (1 + np.exp(-x)),
                reject_poisson_diff=(diff > 0) & (score >= threshold),
                reject_poisson_depth=(diff > 0) & (depth_ > lam) & (tail - correction >= threshold),
                reject_poisson_product=(diff > 0) & (product > expected) & (product_tail - correction >= threshold),
            )[["gid", "hctx", "cov", "diff", "weight", "score", "fake_probability", "reject_poisson_diff", "reject_poisson_depth", "reject_poisson_product"]]

    return run


def score_contexts(cov: DataFrame, depths: DataFrame, threshold: float = 2.0, scale: int = 1) -> DataFrame:
    """Coverage with the scores and verdicts of the Poisson context filters (difference, depth, product) and the fake probability."""
    ship(cov.sparkSession)
    rows = cov.where("cov > 0").join(depths.select("gid", "total", "zero_fraction", "mean_depth"), "gid").join(product_moments(cov, scale).select("gid", F.col("sum").alias("product_sum")), "gid", "left")
    return rows.mapInPandas(_score_contexts(threshold, scale), "gid long, hctx long, cov long, diff int, weight long, score double, fake_probability double, reject_poisson_diff boolean, reject_poisson_depth boolean, reject_poisson_product boolean")


def default_call(breadth: Column, relative: Column, xny: Column, hit: Column, ani: Column, total: Column, small: Column | None = None) -> Column:
    """major, low_abundance, screening or weak; ``small`` marks short-feature domains (resistance, genes), which have their own cuts."""
    enough = lambda cut: (xny >= cut) & (hit >= cut)
    cut = F.least(total, F.greatest(F.lit(100), F.ceil(total / 100)))
    base = (breadth >= 0.5) & enough(cut) & (ani >= 0.95)
    species = F.when(base & (relative >= 1e-4), "major").when(base & (relative >= 1e-5), "low_abundance").otherwise("weak")
    if small is None:
        return species
    high, screen = F.greatest(F.lit(30), F.ceil(total * 0.03)), F.greatest(F.lit(20), F.ceil(total * 0.02))
    feature = F.when((breadth >= 0.6) & enough(high) & (ani >= 0.96), "major").when((breadth >= 0.35) & enough(screen) & (ani >= 0.95), "screening").otherwise("weak")
    return F.when(small, feature).otherwise(species)


def call_order() -> tuple:
    rank = F.when(F.col("call") == "major", 3).when(F.col("call") == "screening", 2).when(F.col("call") == "low_abundance", 1).otherwise(0)
    return rank.desc(), F.desc("relative_depth"), F.desc("breadth"), F.desc("ani"), F.asc("gid")


def normalised(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Shares of the rows at hand; null and negative values count as nothing."""
    positive = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    whole = rows.agg(F.sum(positive).alias("_whole"))
    return rows.join(F.broadcast(whole)).withColumn(name, F.when(F.col("_whole") > 0, positive / F.col("_whole")).otherwise(F.lit(0.0))).drop("_whole")


def track(assigned: DataFrame, max_refs: int = 64, max_contexts: int = 256) -> DataFrame:
    """Per unit: its selected references and contexts, as sorted lists up to the report's caps, with the whole numbers beside them."""
    return assigned.groupBy("unit").agg(
        F.count_distinct("hctx").alias("n_ctx"), F.count_distinct("gid").alias("n_refs"),
        F.slice(F.sort_array(F.collect_set("gid")), 1, max_refs).alias("refs"), F.slice(F.sort_array(F.collect_set("hctx")), 1, max_contexts).alias("contexts"),
    )


def ambiguity_edges(assigned_all: DataFrame, limit_candidates: int | None = None) -> DataFrame:
    """Candidates of contexts that several references share, each with the context's best difference and whether it is selected.

    A report may leave out contexts with more than ``limit_candidates`` references; by default none are.
    """
    shared = assigned_all.where("n_candidates > 1")
    if limit_candidates is not None:
        shared = shared.where(F.col("n_candidates") <= limit_candidates)
    return shared.select("unit", "hctx", "gid", "d", "best", "n_candidates", "n_best", (F.col("d") == F.col("best")).alias("selected"))


def unknown_fraction(ref: DataFrame, reads: DataFrame, ref_density: DataFrame, query_density: float) -> DataFrame:
    """Share of read contexts that no reference of ``ref`` explains, matched ones weighted by the inverse of their capture probability.

    A context's capture probability is the largest density of the references that have it over the query's, at most 1. So references meet in their contexts
    before any read does, and reads are counted by context: no candidate is dealt.
    """
    best = ref.select("gid", "hctx").join(ref_density, "gid").groupBy("hctx").agg(F.max("density").alias("density"))
    counted = reads.select("unit", "hctx").distinct().groupBy("hctx").agg(F.count("*").alias("n")).join(best, "hctx", "left")
    known = F.col("density").isNotNull()
    weight = F.when(known, F.col("n") / F.least(F.lit(1.0), F.col("density") / F.lit(query_density)))
    both = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("contexts"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("observed"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("present"))
    return both.select("contexts", "observed", "present", F.greatest(1 - F.col("present") / F.nullif("contexts", F.lit(0)), F.lit(0.0)).alias("unknown"))


#: Reads of a sample that one task walks through.
BLOCK_READS = 1 << 17


def _carries(size: int):
    """Of one range of reads: for every number of contexts held before it, those held after it and the blocks closed in it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        held, closed = np.arange(size), np.zeros(size, np.int64)
        for n in group.sort_values("read_ord")["n_ctx"].to_numpy():
            held = held + n
            full = held >= size
            closed += full
            held[full] = 0
        return pd.DataFrame({"sample": [group["sample"].iloc[0]], "part": [group["part"].iloc[0]], "after": [held.tolist()], "closed": [closed.tolist()]})

    return run


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    """What each range of a sample finds: contexts held and blocks closed before it."""
    rows, held, block = [], 0, 0
    for part, after, closed in group.sort_values("part")[["part", "after", "closed"]].itertuples(index=False):
        rows.append((part, held, block))
        held, block = int(after[held]), block + int(closed[held])
    parts, before, blocks = zip(*rows, strict=True)
    return pd.DataFrame({"sample": group["sample"].iloc[0], "part": parts, "held": before, "first": blocks})


def _walk(size: int):
    def run(reads: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        held, block = int(found["held"].iloc[0]), int(found["first"].iloc[0])
        rows = reads.sort_values("read_ord")
        out = np.empty(len(rows), np.int64)
        for i, n in enumerate(rows["n_ctx"].to_numpy()):
            out[i] = block
            held += n
            if held >= size:
                held, block = 0, block + 1
        return rows.assign(block=out)[["sample", "read_ord", "block"]]

    return run


def density_blocks(reads: DataFrame, size: int = 100) -> DataFrame:
    """``sample, read_ord, block``: consecutive reads joined until a block has ``size`` contexts.

    Where blocks end depends on all reads before, but only through the number of contexts held, under ``size``.
    So ranges of at most BLOCK_READS ordinals first say what they do to any such number, these small tables are chained per sample,
    and every range is then walked from what it finds. No task has more reads than a range.
    """
    ship(reads.sparkSession)
    dealt = reads.withColumn("part", F.floor(F.col("read_ord") / F.lit(BLOCK_READS)))
    tables = dealt.groupBy("sample", "part").applyInPandas(_carries(size), "sample long, part long, after array<int>, closed array<long>")
    starts = tables.groupBy("sample").applyInPandas(_chain, "sample long, part long, held long, first long")
    return dealt.groupBy("sample", "part").cogroup(starts.groupBy("sample", "part")).applyInPandas(_walk(size), "sample long, read_ord long, block long")
