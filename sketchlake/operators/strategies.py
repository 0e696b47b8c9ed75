"""Strategies of calibrated profiles, the accession candidates beside their calls, and abundance transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchlake.operators import calibrate as C
from sketchlake.operators.order import median

#: When the direct unique calls replace the gate's.
FALLBACK_BASE, FALLBACK_UAF, FALLBACK_EXTRA, FALLBACK_RATIO = 15, 0.50, 0.03, 0.80
#: Identity, shared contexts, breadth and fraction of an accession candidate, by surface.
SURFACE = {"current": (0.90, 100.0, 0.01, 0.70), "strict": (0.93, 650.0, 0.20, 0.0)}
#: Fixed value: the share of the normalised depth that a candidate's mass is.
SURFACE_ALPHA = 2.0
#: Fixed values of the rescue within a genus: identity, contexts, effective depth, largest latent fraction, and how many times the genus's best active row.
WINNER = {"ani": 0.999, "xny": 100.0, "effective": 5.0, "latent_af": 0.25, "ratio": 3.0}


def in_scope(rows: DataFrame, scopes: DataFrame, scope: str) -> DataFrame:
    """Rows of taxids in a scope (``taxid, scope``); prokaryotes are bacteria and archaea, and a taxid without a scope is 'other'."""
    if scope == "all":
        return rows
    known = scopes.groupBy("taxid").agg(F.min("scope").alias("_scope"))
    wanted = ["bacteria", "archaea"] if scope == "prokaryote" else [scope]
    return rows.join(known, "taxid", "left").where(F.coalesce("_scope", F.lit("other")).isin(wanted)).drop("_scope")


def direct_unique(rows: DataFrame) -> DataFrame:
    """Taxids that a unique profile calls by itself."""
    return rows.where((F.col("xny") >= 10) & (F.col("ani") >= 0.95) & (F.col("min_af") >= 0.05)).select("taxid").where("taxid <> ''").distinct()


def best_reference(rows: DataFrame, prefix: str) -> DataFrame:
    """Per taxid, the reference with most shared contexts, then fraction, identity, breadth and depth; the smaller id on ties.

    One aggregate over a struct, so that a taxid's rows meet as partial maxima.
    """
    order = [F.col(c).cast("double") for c in ("xny", "min_af", "ani", "breadth", "mean_depth")]
    best = F.max_by(F.struct("gid", "name", "annotation"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], (-F.col("gid")).alias("last")))
    out = rows.groupBy("taxid").agg(best.alias("b"))
    return out.select("taxid", F.col("b.gid").alias(f"{prefix}_best_gid"), F.col("b.name").alias(f"{prefix}_best_ref"), F.col("b.annotation").alias(f"{prefix}_best_annotation"))


def strategy(features: DataFrame, unique_rows: DataFrame, name: str, threshold: float = 0.35) -> DataFrame:
    """Features plus ``called``, ``raw`` (abundance) and ``fallback``, by probability alone, the adaptive gate, or the gate with a fallback.

    The fallback takes the direct unique calls where the gate's base set is large and well covered, probability adds
    little mass, and direct calls are nearly as many.
    """
    c = F.col
    if name == "probability":
        rows = features.withColumns({"called": c("probability") >= threshold, "raw": F.greatest("s_normalized_depth", F.lit(0.0)), "fallback": F.lit(False)})
        return rows
    gated = C.adaptive_gate(features, threshold)
    gated = gated.withColumn("raw", C.panel_abundance())
    if name == "adaptive":
        return gated.withColumn("fallback", F.lit(False))
    if name != "universal":
        raise ValueError(f"probability, adaptive or universal: {name!r}")
    direct = direct_unique(unique_rows)
    base = (c("u_xny") >= 10) & (c("u_ani") >= 0.95) & (c("u_min_af") >= 0.05)
    mass = lambda x: F.coalesce(F.sum(F.when(x, c("s_normalized_depth"))), F.lit(0.0))
    scalars = gated.agg(
        F.count_if(base).alias("_n"), F.coalesce(F.median(F.when(base, c("u_min_af"))), F.lit(0.0)).alias("_uaf"), (mass((c("probability") >= threshold) & ~base) / (mass(base) + 1e-12)).alias("_extra")
    )  # one row
    number = direct.agg(F.count("*").alias("_direct"))  # one row
    enough = (c("_n") >= FALLBACK_BASE) & (c("_uaf") >= FALLBACK_UAF) & (c("_extra") <= FALLBACK_EXTRA) & (c("_direct") / F.greatest(c("_n"), F.lit(1)) >= FALLBACK_RATIO)
    rows = gated.join(F.broadcast(scalars)).join(F.broadcast(number)).withColumn("fallback", enough)
    rows = rows.join(direct.withColumn("_in", F.lit(True)), "taxid", "left")
    return rows.withColumn("called", F.when(c("fallback"), F.coalesce("_in", F.lit(False))).otherwise(c("called"))).drop("_n", "_uaf", "_extra", "_direct", "_in")


def reported(fallback: Column) -> tuple[Column, Column]:
    """The identity that is reported and its source: split, unless the fallback acts or split has none."""
    unique = (F.col("u_latent_ani") > 0) & (fallback | (F.col("s_latent_ani") <= 0))
    return F.when(unique, F.col("u_latent_ani")).otherwise(F.col("s_latent_ani")), F.when(unique, "unique").otherwise("split")


def candidate_surface(unique_rows: DataFrame, split_rows: DataFrame, called_species: DataFrame, mode: str, with_mass: bool = False, max_called: int = 0, rules: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """One accession of each uncalled species that passes a surface's rule, from both profiles.

    Rows have ``gid, taxid, species`` and measures; ``mode`` is current, strict or either. Of a species, the row with most
    shared contexts stays, then fraction, identity and breadth; the unique profile's and the smaller id on ties. With more than
    ``max_called`` called species (if given) there are no candidates. ``mass`` is in normalised depth, 0 unless asked for.
    ``rules`` override the fixed cuts (identity, shared contexts, breadth, fraction) of a surface.
    """
    cuts = SURFACE | (rules or {})
    if mode not in (*cuts, "either"):
        raise ValueError(f"one of {(*cuts, 'either')}: {mode!r}")
    passes = F.lit(False)
    for name in cuts if mode == "either" else (mode,):
        ani, xny, breadth, af = cuts[name]
        passes = passes | ((F.col("ani") >= ani) & (F.col("xny") >= xny) & (F.col("breadth") >= breadth) & (F.col("min_af") >= af))
    keep = ["gid", "taxid", "species", "ani", "xny", "breadth", "min_af", "normalized_depth"]
    both = unique_rows.select(*keep, F.lit("unique").alias("profile")).unionByName(split_rows.select(*keep, F.lit("split").alias("profile")))
    species = called_species.select("species").where("species <> ''").distinct()
    left = both.where(passes & (F.col("species") != "")).join(species, "species", "left_anti")
    order = F.struct(*[F.col(c).cast("double").alias(c) for c in ("xny", "min_af", "ani", "breadth")], (F.col("profile") == "unique").alias("u"), (-F.col("gid")).alias("g"))
    best = left.groupBy("species").agg(F.max_by(F.struct("gid", "taxid", "profile", "ani", "xny", "breadth", "min_af", "normalized_depth"), order).alias("b")).select("species", "b.*")
    if max_called > 0:
        number = species.agg(F.count("*").alias("_called"))  # one row
        best = best.join(F.broadcast(number)).where(F.col("_called") <= max_called).drop("_called")
    mass = F.greatest(SURFACE_ALPHA * F.col("normalized_depth"), F.lit(0.0)) if with_mass else F.lit(0.0)
    return best.withColumn("mass", mass)


def winner_rescue(rows: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Rows (``gid, genus, active`` and measures) plus ``rescued``: of each genus with an active row, the deepest inactive row that is far deeper than the active ones yet narrow."""
    cut = {**WINNER, **(limits or {})}
    c = F.col
    top = F.max(F.when(c("active") & (c("effective") > 0), c("effective"))).over(Window.partitionBy("genus"))
    rows = rows.withColumn("_top", top)
    enough = ~c("active") & (c("ani") >= cut["ani"]) & (c("xny") >= cut["xny"]) & (c("effective") >= cut["effective"]) & (c("effective") > 0) & (c("latent_af") <= cut["latent_af"]) & (c("effective") >= cut["ratio"] * c("_top"))
    rows = rows.withColumn("_ok", F.coalesce(enough, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("genus", "_ok").orderBy(F.desc("effective"), F.desc("xny"), "gid"))
    return rows.withColumn("rescued", c("_ok") & (place == 1)).drop("_top", "_ok")


def transformed(rows: DataFrame, value: str, power: float = 1.0, cap: float = 0.0, floor: float = 0.0) -> DataFrame:
    """Positive values plus ``transformed``: capped at ``cap`` medians, raised by ``floor`` medians, then to ``power``; the median is that of the values as given."""
    positive = rows.where(F.col(value) > 0)
    middle = median(positive, value, "_m")
    v = F.col(value).cast("double")
    v = F.least(v, F.col("_m") * cap) if cap > 0 else v
    v = v + F.col("_m") * floor if floor > 0 else v
    return positive.join(F.broadcast(middle)).withColumn("transformed", F.pow(v, F.lit(power)) if power != 1 else v).drop("_m")


def combined(marker: DataFrame, added: DataFrame, mode: str, share: float = 0.0, uniform: float = 0.0) -> DataFrame:
    """``key, share`` of two value tables ``key, value``: markers first, sums, or fixed masses of both groups; ``uniform`` of the mass is spread evenly.

    Without markers or without additions, masses are as with markers first.
    """
    m, a = (t.groupBy("key").agg(F.sum("value").alias(n)) for t, n in ((marker, "m"), (added, "a")))
    both = m.join(a, "key", "full_outer")
    first = F.coalesce("m", "a")
    if mode == "sum":
        value = F.coalesce("m", F.lit(0.0)) + F.coalesce("a", F.lit(0.0))
    elif mode == "marker":
        value = first
    elif mode == "mass":
        whole = both.agg(F.sum("m").alias("_m"), F.sum("a").alias("_a"))  # one row
        both = both.join(F.broadcast(whole))
        part = (1 - share) * F.coalesce("m", F.lit(0.0)) / F.col("_m") + share * F.coalesce("a", F.lit(0.0)) / F.col("_a")
        value = F.when((F.col("_m") > 0) & (F.col("_a") > 0), part).otherwise(F.coalesce("a", "m"))
    else:
        raise ValueError(f"marker, sum or mass: {mode!r}")
    valued = both.select("key", value.alias("_v")).where("_v > 0")
    total = valued.agg(F.sum("_v").alias("_t"), F.count("*").alias("_k"))  # one row
    return valued.join(F.broadcast(total)).select("key", ((1 - uniform) * F.col("_v") / F.col("_t") + uniform / F.col("_k")).alias("share"))


def best_threshold(rows: DataFrame, truth: DataFrame, steps: int = 91, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: the threshold of the grid with the best mean F1 over samples; on ties fewer errors, then the one nearest to a half, then the smallest.

    ``rows`` have ``sample, score, label``; ``truth`` has ``sample, positives``, which may be more than the rows show. Rows are first counted
    per sample and grid cell; what meets the grid is at most ``steps`` cells a sample.
    """
    c = F.col
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    cell = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= c("score")))
    counted = rows.groupBy("sample", cell.alias("cell")).agg(F.sum(c("label").cast("long")).alias("pos"), F.count("*").alias("n"))
    per = counted.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("pos", "n")))).alias("cells"))  # at most steps + 1 entries
    every = rows.select("sample").distinct().join(truth, "sample").join(per, "sample")
    points = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])).alias("g")
    over = lambda field: F.aggregate(F.filter(F.map_entries("cells"), lambda e: e["key"] >= c("g.at")), F.lit(0).cast("long"), lambda s, e: s + e["value"][field])
    met = every.select("sample", "positives", "cells", points).select("sample", c("g.threshold").alias("threshold"), "positives", over("pos").alias("tp"), over("n").alias("called"))
    errors = (c("called") - c("tp")) + (c("positives") - c("tp"))
    f1 = F.when(c("tp") > 0, 2 * c("tp") / (c("called") + c("positives"))).otherwise(F.lit(0.0))
    scored = met.groupBy("threshold").agg(F.round(F.avg(f1), 12).alias("f1"), F.round(F.avg(errors), 9).alias("errors"))
    order = F.struct(c("f1"), (-c("errors")).alias("e"), (-F.round(F.abs(c("threshold") - 0.5), 9)).alias("h"), (-c("threshold")).alias("t"))
    return scored.agg(F.max_by(F.struct("threshold", "f1", "errors"), order).alias("b")).select("b.*")


def stratified(pairs: DataFrame, value: str, edges: list[float], per_bin: int, keys: list[str]) -> DataFrame:
    """Labelled pairs plus ``bin``: at most ``per_bin`` of each bin of a value, drawn by the hash of their keys; a draw for fitting, of bounded size."""
    cell = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(edges)]), lambda e: e <= F.col(value)))
    place = F.row_number().over(Window.partitionBy("bin").orderBy(F.xxhash64(*keys), *keys))
    return pairs.withColumn("bin", cell).withColumn("_place", place).where(F.col("_place") <= per_bin).drop("_place")


def regression_scores(rows: DataFrame, predicted: str, truth: str, cutoffs: list[float]) -> DataFrame:
    """One row: errors, linear correlation, and for each cutoff how many rows fall on the wrong side of it."""
    gap = F.col(predicted) - F.col(truth)
    wrong = [F.count_if((F.col(predicted) >= x) != (F.col(truth) >= x)).alias(f"wrong_at_{round(x * 1000)}") for x in cutoffs]
    return rows.agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.corr(predicted, truth).alias("pearson"), *wrong)
