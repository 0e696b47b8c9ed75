"""Identity reports, evidence, latent fractions, strategies and text tables against plain Python."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sketchlake.functions import latent as L
from sketchlake.functions import trees
from sketchlake.operators import detail as I
from sketchlake.operators import evidence as E
from sketchlake.operators import readwise as R
from sketchlake.operators import strategies as Y
from sketchlake.operators import taxonomy as T
from sketchlake.sources import tables as S

PAIR = "qry long, ref long, xny long, n_diff_obj long, n_diff_section long, n_mut2 long, x_ctx long, y_ctx long, af_qry double, af_ref double, real_af_qry double, real_af_ref double, qry_complete boolean"


def fixed(value):
    return lambda rows: rows.withColumn("calibrated_ani", F.lit(value))


def identity(n, q, r):
    j = n / (q + r - n)
    return [1 + math.log(2 * j / (1 + j)) / 22, 1 + math.log(n / min(q, r)) / 22]


def test_the_guard_takes_the_exact_contexts(spark):
    rows = [(1, 2, n, nd, nd + m, m, 10000, 10000, n / 10000, n / 10000, real, real, complete) for n in (2600, 3300, 4400) for nd in (100, 400, 800, 1500) for m in (5, 60) for real in (n / 10000, None) for complete in (True, False, None)]
    found = I.identities(spark.createDataFrame(rows, PAIR), 10000, I.Choice(af_cut=0.2), fixed(0.99)).collect()
    for r in found:
        exact = identity(r["xny"] - r["n_diff_obj"], 10000, 10000)
        mean = sum(identity(r["xny"], 10000, 10000) + exact) / 4
        acts = bool(r["qry_complete"]) and r["real_af_qry"] is not None and r["ani"] >= 0.958 and r["ani"] - mean >= 0.015
        assert r["guarded"] == acts and r["distance"] == pytest.approx(1 - exact[1] if acts else 0.01)
        assert (r["confidence"] == "guarded_low_confidence") == acts
    assert len({r["guarded"] for r in found}) == 2


@pytest.mark.parametrize("metric, af, calibrated, mode, expected", [
    (1, 0.9, 0.99, {}, 1), (1, 0.9, None, {}, 3), (2, 0.9, 0.99, {}, 2), (1, 0.9, 0.0, {}, 3), (1, 0.1, 0.99, {}, 3), (5, 0.9, 0.99, {}, 5), (-6, 0.9, 0.99, {}, 6), (99, 0.9, 0.99, {}, 1),
    (1, 0.9, 0.99, {"raw": True}, 3), (3, 0.9, 0.99, {"reads": True}, 4), (7, 0.9, 0.99, {"reads": True}, 7), (1, 0.9, 0.99, {"reads": True, "one_metric": True}, 3),
])
def test_metrics_fall_back(spark, metric, af, calibrated, mode, expected):
    rows = spark.createDataFrame([(1, 2, 900, 10, 10, 0, 1000, 1000, af, af, None, None, True)], PAIR)
    found = I.identities(rows, 10000, I.Choice(metric=metric, **mode), fixed(calibrated) if calibrated is not None else None)
    row = found.first()
    assert row["selected"] == expected
    table = I.detail_rows(found.withColumn("annotation", F.lit("")), 10000)
    assert tuple(table.columns) == I.COLUMNS
    shown = table.first()
    assert shown["Selected_metric"] == I.METRICS[expected - 1] and shown["AF_source"] == "sketch" and shown["Ref_annotation"] == "NA" and shown["Real_min_align_fraction"] == 0
    if af < 0.5:
        assert row["distance"] == 1.0


def test_complete_assemblies(spark):
    rows = spark.createDataFrame([(4_000_000, 1, 4_000_000, True), (4_000_000, 1, 4_000_000, False), (4_000_000, 5, 4_000_000, True), (3_499_999, 1, 3_499_999, True), (4_000_000, 4, 700_000, True), (None, 1, 1, True), (4_000_000, 1, 0, True)], "t long, n long, m long, f boolean")
    assert [r[0] for r in rows.select(I.complete_assembly(F.col("t"), F.col("n"), F.col("m"), F.col("f"))).collect()] == [True, False, False, False, False, False, False]


def test_tree_inputs_and_missing_values():
    rows = pd.DataFrame({"ani": [0.98, 1.2], "af_ref": [0.2, 0.0], "xny": [100, 10], "n_diff_obj": [10, 1], "n_diff_section": [20, 1], "n_mut2": [5, 0]})
    x = trees.features(rows, 200)
    assert x.shape == (2, 11) and x[0, 2] == pytest.approx(math.log1p(5000)) and list(x[0, 8:]) == [0, 1, 0] and list(x[1, 8:]) == [1, 0, 0]
    assert x[0, 6] == pytest.approx(1 + math.log(0.2) / 11) and x[0, 7] == pytest.approx(0.98 - x[0, 6]) and x[1, 0] == 1.0 and x[1, 6] == 0.0
    tree = {"feature": [0, -1, -1], "threshold": [0.5, 0, 0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0, 0.1, 0.2], "missing_left": [True, False, False]}
    assert list(trees.predict({"baseline": 0.0, "trees": [tree]}, np.array([[np.nan], [0.9], [0.1]]))) == [0.1, 0.2, 0.1]


def test_latent_solvers(spark):
    rates = [0.05, 0.5, 1.0, 3.0, 40.0]
    rows = spark.createDataFrame([(0.4, r / (1 - math.exp(-r)), r) for r in rates], "b double, m double, r double")
    for row in rows.select(L.truncated_rate(F.col("m")).alias("rate"), "r", L.truncated_fraction(F.col("b"), F.col("m")).alias("f")).collect():
        assert row["rate"] == pytest.approx(row["r"], rel=1e-9) and row["f"] == pytest.approx(min(1, 0.4 / (1 - math.exp(-row["r"]))))
    odd = spark.createDataFrame([(None, None, None), (0.0, 2.0, 3.0), (1.0, 2.0, 3.0), (0.3, 0.0, 0.0), (0.3, float("nan"), 1.0)], "b double, m double, v double")
    got = odd.select(L.truncated_fraction(F.col("b"), F.col("m")), L.poisson_grid(F.col("b"), F.col("m")), L.negative_binomial_grid(F.col("b"), F.col("m"), F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 0.3, 0.3), (1, 0.3, 0.3)]
    cases = [(b, m, v) for b, m, v in itertools.product((0.1, 0.5, 0.84), (0.2, 1.7, 6.0), (0.5, 2.0, 30.0))]
    rows = spark.createDataFrame(cases, "b double, m double, v double").select("b", "m", "v", L.poisson_grid(F.col("b"), F.col("m")).alias("p"), L.negative_binomial_grid(F.col("b"), F.col("m"), F.col("v")).alias("n"))
    for r in rows.collect():
        b, m, v = r["b"], r["m"], r["v"]
        pi = b + (1 - b) * np.arange(512) / 511
        assert r["p"] == pytest.approx(pi[np.argmin((pi * -np.expm1(-m / pi) - b) ** 2)])
        inverse = (v - m) * pi / m**2 - (1 - pi)
        ok = inverse > 1e-9
        if v <= m or not ok.any():
            assert r["n"] == b
        else:
            k = 1 / np.where(ok, inverse, 1.0)
            gap = np.where(ok, (pi * (1 - (k / (k + m / pi)) ** k) - b) ** 2, np.inf)
            assert r["n"] == pytest.approx(pi[np.argmin(gap)])
    chance = spark.range(1).select(L.trackable(F.lit(10), F.lit(0.1)), L.trackable(F.lit(0), F.lit(0.1)), L.trackable(F.lit(3), F.lit(1.0)), L.trackable(F.lit(3), F.lit(0.0))).first()
    assert chance[0] == pytest.approx(1 - 0.9**10) and tuple(chance)[1:] == (0, 1, 0)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    ref = spark.createDataFrame([(g, int(c), int(rng.integers(4))) for g in range(4) for c in rng.choice(60, 40, replace=False)], "gid long, hctx long, obj int")
    reads = [(u, int(c), int(rng.integers(4)), i) for u in range(50) for i, c in enumerate(rng.integers(0, 80, 12))]
    return ref, spark.createDataFrame(reads, "unit long, hctx long, obj int, offset long")


def test_tracks_equal_a_walk_over_reads(spark, world):
    ref, reads = world
    found = R.candidates(reads, ref)
    lineages = spark.createDataFrame([(0, "A|B|x"), (1, "A|B|y"), (2, "A|C|z"), (3, None)], "gid long, path string")
    got = {r["unit"]: r for r in E.track_rows(reads, found, "best-diff", {"tax": lineages}, max_offsets=6).collect()}
    entries, by_unit = {}, {}
    for r in ref.collect():
        entries.setdefault(r["hctx"], {}).setdefault(r["gid"], []).append(r["obj"])
    for r in reads.collect():
        by_unit.setdefault(r["unit"], []).append(r)
    differ = lambda a, b: sum((a >> 2 * i) & 3 != (b >> 2 * i) & 3 for i in range(16))
    for unit, places in by_unit.items():
        gids, offsets, matched = set(), [], 0
        for ctx in {p["hctx"] for p in places}:
            mine = [p for p in places if p["hctx"] == ctx]
            d = {g: min(differ(p["obj"], o) for p in mine for o in objs) for g, objs in entries.get(ctx, {}).items()}
            if d:
                matched += len(mine)
                gids |= {g for g in d if d[g] == min(d.values())}
                offsets += [p["offset"] for p in mine]
        if not gids:
            assert unit not in got
            continue
        row = got[unit]
        assert (row["density_ctx"], row["matched_ctx"], row["selected_ctx"]) == (len(places), matched, matched) and row["refs"] == sorted(gids)
        assert row["offsets"] == sorted(offsets)[:6] and row["offsets_cut"] == (len(offsets) > 6) and row["status"] == ("multi_ref_lca" if len(gids) > 1 else "single_ref")
        assert (row["tax_rank"] == "NA") == (gids == {3})
    summary = {r["metric"]: r["value"] for r in E.track_summary(reads, reads.groupBy("unit").agg(F.count("*").alias("possible_ctx")), E.track_rows(reads, found, "best-diff"), found, ref.select("gid").distinct().withColumn("density", F.lit(0.5)), 1.0).collect()}
    matched = sum(r["matched_ctx"] for r in got.values())
    assert summary["total_matched_ctx"] == matched and summary["sketch_corrected_estimated_ref_present_ctx"] == pytest.approx(2 * matched) and summary["sketch_corrected_mean_capture_probability"] == 0.5


@pytest.mark.parametrize("model", E.MODELS)
def test_filters_keep_what_they_say(world, model):
    ref, reads = world
    cov = R.coverage(R.assign(R.candidates(reads, ref), "best-diff-split")).cache()
    total = R.totals(ref)
    depths = R.depth(cov, total, R.SPLIT_SCALE)
    rows = E.filtered(cov, depths, model, threshold=0.5, scale=R.SPLIT_SCALE)
    found = rows.collect()
    assert len(found) == cov.count() and all((r["part"] == 0) == r["rejected"] or model == "fake-prob" for r in found)
    features = {r["gid"]: r for r in E.reliable_features(rows, R.SPLIT_SCALE).collect()}
    for gid, f in features.items():
        mine = [r for r in found if r["gid"] == gid]
        assert f["raw_xny"] == len(mine) and f["rejected_ctx"] == sum(r["rejected"] or r["adjusted"] for r in mine)
        assert f["xny"] == math.floor(sum(r["part"] for r in mine) / 1024 + 0.5)
        assert f["n_diff_section"] == math.floor(sum(r["part"] * r["diff"] for r in mine) / 1024 + 0.5)
    if model == "none":
        plain = {r["gid"]: r["xny"] for r in R.features(cov).collect()}
        assert plain == {g: f["xny"] for g, f in features.items()}
    depth = E.reliable_depth(rows, total, R.SPLIT_SCALE).collect()
    assert {r["gid"]: r["reliable_hit_ctx"] for r in depth} == {g: sum(not r["rejected"] for r in found if r["gid"] == g) for g in range(4)}


def test_marker_evidence_stands_beside_the_whole(world):
    ref, reads = world
    rows = E.dual_evidence(R.assign(R.candidates(reads, ref), "best-diff-split"), ref, scale=R.SPLIT_SCALE).collect()
    single = {r["gid"]: r["n"] for r in ref.join(R.marker_contexts(ref), "hctx").groupBy("gid").agg(F.count_distinct("hctx").alias("n")).collect()}
    assert {r["gid"]: r["marker_total"] for r in rows} == {g: single.get(g) for g in range(4)}
    assert all(r["marker_xny"] is None or r["marker_xny"] <= r["xny"] for r in rows)


def test_universal_strategy_falls_back_to_direct_calls(spark):
    names = [c for c in ("ani", "xny", "min_af", "breadth", "mean_depth", "hit_mean_depth", "normalized_depth", "latent_af", "latent_ani")]
    schema = "taxid string, name string, probability double, " + ", ".join(f"{p}_{n} double" for p in "us" for n in names)
    good = [0.99, 600.0, 0.9, 0.9, 5.0, 5.0, 0.05, 0.9, 0.99]
    rows = spark.createDataFrame([(str(i), f"G{i} s", 0.9, *good, *good) for i in range(20)], schema)
    unique = spark.createDataFrame([(str(i), 600, 0.99, 0.9) for i in range(18)] + [("18", 5, 0.99, 0.9)], "taxid string, xny long, ani double, min_af double")
    found = {r["taxid"]: (r["called"], r["fallback"]) for r in Y.strategy(rows, unique, "universal").collect()}
    assert found == {str(i): (i < 18, True) for i in range(20)}
    few = Y.strategy(rows, unique.where("taxid < '1'"), "universal").collect()
    assert all(r["called"] and not r["fallback"] for r in few)
    with pytest.raises(ValueError):
        Y.strategy(rows, unique, "other")


def test_candidates_are_one_per_uncalled_species(spark):
    schema = "gid long, taxid string, species string, ani double, xny long, breadth double, min_af double, normalized_depth double"
    unique = spark.createDataFrame([(1, "1", "a", 0.95, 200, 0.1, 0.8, 0.1), (2, "1", "a", 0.95, 300, 0.1, 0.8, 0.2), (3, "2", "b", 0.95, 900, 0.5, 0.8, 0.3), (4, "3", "", 0.95, 900, 0.5, 0.8, 0.3)], schema)
    split = spark.createDataFrame([(2, "1", "a", 0.95, 300, 0.1, 0.8, 0.4), (5, "4", "c", 0.94, 700, 0.3, 0.1, 0.5), (6, "5", "d", 0.5, 900, 0.5, 0.9, 0.5)], schema)
    called = spark.createDataFrame([("b",)], "species string")
    pick = lambda mode, **k: {r["species"]: (r["gid"], r["profile"], r["mass"]) for r in Y.candidate_surface(unique, split, called, mode, **k).collect()}
    assert pick("current") == {"a": (2, "unique", 0.0)} and pick("strict") == {"c": (5, "split", 0.0)}
    assert pick("either", with_mass=True) == {"a": (2, "unique", 0.4), "c": (5, "split", 1.0)}
    assert len(pick("either", max_called=1)) == 2 and pick("either", max_called=0) != {}
    more = spark.createDataFrame([("b",), ("x",)], "species string")
    assert Y.candidate_surface(unique, split, more, "either", max_called=1).isEmpty()


def test_stratified_draws_are_bounded_and_stable(spark):
    rows = spark.range(1000).select("id", (F.col("id") / 1000).alias("v"))
    a = {r["id"] for r in Y.stratified(rows, "v", [0.5, 0.9], 30, ["id"]).collect()}
    assert len(a) == 90 and a == {r["id"] for r in Y.stratified(rows.repartition(7), "v", [0.5, 0.9], 30, ["id"]).collect()}


def test_deepest_record(spark):
    rows = spark.createDataFrame([(1, "g", "genus", "a|b"), (1, "s", "species", "a|b|c"), (1, "t", "species", "a|b|c"), (2, "x", None, "a|b|c|d"), (2, "y", "Phylum", "a")], "gid long, taxid string, rank string, taxpath string")
    assert {r["gid"]: r["taxid"] for r in T.deepest(rows).collect()} == {1: "s", 2: "y"}


def test_text_tables(spark, tmp_path):
    gold = tmp_path / "gold.txt"
    gold.write_text("@SampleID:s1\n@Version:0.9\n\n@@TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE\n1\tgenus\t1\tA\t60\n2\tspecies\t1|2\tA|A b\t40.5\r\n2\tspecies\t1|2\tA|twice\t1\n3\tspecies\t1|3\tA|unidentified\t5\n4\tspecies\t1|4\tA|A c\t0\n5\tspecies\t1|5\tA|A d\tbad\n@SampleID: s2 \n2\tspecies\t1|2\tA|A b\t9\n")
    rows = S.read_gold(spark, str(gold)).collect()
    assert {(r["sample"], r["taxid"], r["species"], r["percentage"]) for r in rows} == {("s1", "2", "A b", 40.5), ("s2", "2", "A b", 9.0)}
    tax = tmp_path / "tax.tsv"
    tax.write_text("ref_key\tTAXID\tRANK\tTAXPATH\tTAXPATHSN\nx_GCF_000000001.1_y\t7\tspecies\t1|7\tA|A e\nGCF_000000001.1\t8\tspecies\t1|8\tA|A f\nz\t9\tgenus\t1\tA\nx_GCF_000000002.1_y\t7\tspecies\t1|7\tA|A e\nGCF_000000003\t6\tspecies\t1|6\tA|A g\n")
    species = S.read_species_map(spark, str(tax))
    assert {r["ref_key"]: r["taxid"] for r in species.collect()} == {"x_GCF_000000001.1_y": "7", "GCF_000000001.1": "8", "x_GCF_000000002.1_y": "7", "GCF_000000002.1": "7", "GCF_000000003": "6"}
    hits = spark.createDataFrame([("GCF_000000002.1",), ("GCF_000000003.5",), ("none",)], "accession string")
    assert {r["accession"]: (r["taxid"], r["species"]) for r in S.map_accessions(hits, species).collect()} == {"GCF_000000002.1": ("7", "A e"), "GCF_000000003.5": ("6", "A g"), "none": ("", "")}
    groups = tmp_path / "groups.tsv"
    groups.write_text("3\tx\n0\n3\tx\n5\n")
    table = S.read_grouping(spark, str(groups))
    assert [(r["gid"], r["taxid"], r["name"]) for r in table.orderBy("gid").collect()] == [(0, 3, "x"), (1, 0, None), (2, 3, "x"), (3, 5, None)]
    S.check_grouping(table, 4)
    assert {r["name"]: r["members"] for r in S.group_names(table).collect()} == {"3_x": 2, "5": 1}
    for bad, n in (("1\n", 2), ("1\ta\n1\tb\n", 2), ("x\n", 1)):
        groups.write_text(bad)
        with pytest.raises(ValueError):
            S.check_grouping(S.read_grouping(spark, str(groups)), n)


def test_pairs_of_reports_are_dealt_once_and_stay_out_of_python(spark):
    """Of related samples: features dealt by query are those joined twice, and the plan has no Python and no join of pairs by reference."""
    from sketchlake import report_queries as Z
    from sketchlake.operators import pairs as P
    from sketchlake.operators import sketch as K

    k = K.build(Z.related(spark, "/root/testdata/sf0.001"), 50)
    known = P.context_counts(k).select("gid", (F.col("gid") * 3).alias("x"))
    got, want = P.triangle_features(k, known), P.features(P.matches(k, k, triangle=True), P.context_counts(k))
    assert sorted(map(tuple, got.drop("x_qry", "x_ref").collect())) == sorted(map(tuple, want.collect())) != []
    assert got.where("x_qry <> 3 * qry or x_ref <> 3 * ref").isEmpty()
    plan = Z.Q.QUERIES["identity_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "hashpartitioning(ref" not in plan


def test_an_ensemble_as_a_column_gives_what_it_gives_in_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame(pd.DataFrame({"xny": rng.integers(0, 200, 300), "n_diff_obj": rng.integers(0, 50, 300), "n_diff_section": rng.integers(0, 90, 300), "n_mut2": rng.integers(0, 30, 300), "ani": rng.random(300) * 0.1 + 0.9, "af_ref": rng.random(300)}))
    model = {"baseline": 0.9, "trees": [{"feature": [0, 2, -1, -1, -1], "threshold": [0.95, 6.0, 0, 0, 0], "left": [1, 3, 0, 0, 0], "right": [2, 4, 0, 0, 0], "value": [0, 0, 0.02, -0.03, 0.2]}]}
    got = trees.recalibrate(frame, model, 200).toPandas()
    monkeypatch.setattr(trees, "EXPRESSION_NODES", 0)
    want = trees.recalibrate(frame, model, 200).toPandas()
    assert np.allclose(got["calibrated_ani"], want["calibrated_ani"]) and got["calibrated_ani"].nunique() > 3
