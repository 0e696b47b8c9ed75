"""Call models, rule grids and held-out samples against plain versions; verdicts that vary on the given tables."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from sketchlake.functions import trees
from sketchlake.operators import call_model as M
from sketchlake.operators import modelling as N
from sketchlake.operators.order import median, with_running_sum
import sketchlake.report_queries  # noqa: F401  (adds its queries)
from sketchlake.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def labelled(spark):
    dice = random.Random(8)
    rows = []
    for i in range(300):
        a, b, c = dice.random(), dice.random(), dice.choice([0.0, 1.0, None, float("nan")])
        rows.append((str(i), a, b, c, float(a + 0.5 * b + dice.gauss(0, 0.1) > 0.8)))
    return spark.createDataFrame(rows, "taxid string, a double, b double, c double, label double").repartition(3).cache()


def test_probability_is_that_of_the_fitted_models(spark, labelled, tmp_path):
    bundle = M.fit(labelled, "pool", columns=COLUMNS, trees=5, depth=3, rounds=4)
    data, medians = M._assembled(labelled, COLUMNS, "label")
    share = data.agg(F.avg("_label")).first()[0]
    weighted = data.withColumn("_w", F.when(F.col("_label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="_w", numTrees=5, maxDepth=3, minInstancesPerNode=3, seed=17, rawPredictionCol="r1", probabilityCol="p1", predictionCol="q1").fit(weighted)
    boosted = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=4, maxDepth=2, stepSize=0.1, minInstancesPerNode=3, seed=17).fit(data)
    apart = forest.transform(data).drop("r1", "q1").select("*", F.col("p1").alias("p1_")).drop("p1").withColumnRenamed("p1_", "p1")
    both = boosted.transform(apart).withColumnRenamed("probability", "p2").select(*COLUMNS, "p1", "p2", M.probability(bundle).alias("p"))
    for r in both.collect():
        assert abs(r.p - 0.5 * (r.p1[1] + r.p2[1])) < 1e-9
    scored = labelled.withColumn("p", M.probability(bundle))
    assert scored.where("(p >= 0.5) = (label = 1)").count() > 255 and scored.where("p is null").count() == 0 and set(bundle["medians"]) == set(COLUMNS) and medians == bundle["medians"]


def test_model_files_are_found_and_checked(spark, labelled, tmp_path):
    folder = str(tmp_path / "cache")
    fitted = []

    def rows():
        fitted.append(1)
        return labelled

    options = {"columns": COLUMNS, "trees": 3, "depth": 2, "rounds": 2}
    first = M.load_or_fit(spark, folder, rows, "pool", "prokaryote", True, write=True, **options)
    again = M.load_or_fit(spark, folder, rows, "pool", "prokaryote", True, **options)
    assert first == again and fitted == [1]
    assert M.load_or_fit(spark, None, rows, "pool", **options)["metadata"]["scope"] == "all" and fitted == [1, 1]
    path = M.cache_names(folder, "pool", "prokaryote", True)[0]
    with pytest.raises(ValueError, match="pool"):
        M.load(spark, path, pool="other", columns=COLUMNS)
    with pytest.raises(ValueError, match="other columns"):
        M.load(spark, path)
    with pytest.raises(ValueError, match="version"):
        M.check({**first, "version": 2}, columns=COLUMNS)
    with pytest.raises(ValueError, match="forest"):
        M.check({"models": []}, columns=COLUMNS)
    spark.createDataFrame([("not json",)], "value string").coalesce(1).write.text(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="not a model"):
        M.load(spark, str(tmp_path / "bad"))
    assert M.bundled()["columns"] == list(M.COLUMNS) and len(json.dumps(M.bundled())) < 20_000


def test_training_needs_both_labels_within_the_scope(spark, labelled):
    features = labelled.select("taxid", *COLUMNS)
    truth = labelled.where("label = 1").select("taxid")
    scopes = labelled.select("taxid", F.when(F.col("taxid").cast("int") % 3 == 0, "bacteria").when(F.col("taxid").cast("int") % 3 == 1, "archaea").otherwise("viruses").alias("scope"))
    rows = M.training_rows(features, truth, scopes=scopes, scope="prokaryote")
    assert rows.count() == 200 and rows.where("label = 1").count() == labelled.where("label = 1 and cast(taxid as int) % 3 < 2").count()
    with pytest.raises(ValueError, match="positive and negative"):
        M.training_rows(features, truth.where("false"))


def test_boosted_numbers_fit_and_export(spark, labelled):
    rows = labelled.withColumn("y", 0.4 * F.col("a") + F.when(F.col("b") > 0.5, 0.3).otherwise(0.0))
    model = M.fit_regression(rows, ["a", "b"], "y", rounds=30)
    x = np.array([[r.a, r.b] for r in rows.collect()])
    y = np.array([r.y for r in rows.collect()])
    assert np.abs(trees.predict(model, x) - y).mean() < 0.04


# --- rule grids and held-out samples -----------------------------------------------------------------------------------


def test_grid_equals_applying_every_rule(spark):
    dice = random.Random(3)
    odd = lambda x: None if dice.random() < 0.03 else float(x)
    rows = [(dice.choice("xyz"), dice.randint(0, 1), *[odd(v) for v in (dice.choice([0.0, 1, 9, 10, 50]), dice.choice([0.9, 0.93, 0.94, 0.97]), dice.choice([0.0, 0.005, 0.03, 0.1]), dice.choice([10.0, 25, 100]), dice.choice([0.92, 0.95, 0.96]), dice.choice([0.01, 0.02, 0.05]), dice.choice([1.0, 2.0, 3.0, 6.0]), 1.0)]) for _ in range(400)]
    names = ("sample", "label", "u_xny", "u_ani", "u_breadth", "s_xny", "s_ani", "s_breadth", "xny_ratio", "breadth_ratio")
    frame = spark.createDataFrame(rows, "sample string, label int, " + ", ".join(f"{n} double" for n in names[2:])).repartition(4)
    positives = frame.groupBy("sample").agg((F.sum("label") + 2).alias("positives"))
    scored = N.hybrid_grid(frame, positives)
    got = {(r["sample"], r.param_id): (r.called, r.tp, r.fn) for r in scored.collect()}
    low = lambda v, cut: v is not None and v >= cut
    high = lambda v, cut: v is not None and v <= cut
    means = {}
    for k, point in enumerate(itertools.product(*N.HYBRID_GRID.values())):
        p = dict(zip(N.HYBRID_GRID, point, strict=True))
        f1s, errors = [], []
        for s in "xyz":
            own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == s]
            ok = [r for r in own if (low(r["u_xny"], p["u_xny"]) and low(r["u_ani"], p["u_ani"]) and low(r["u_breadth"], p["u_breadth"])) or (
                low(r["s_xny"], p["s_xny"]) and low(r["s_ani"], p["s_ani"]) and low(r["s_breadth"], p["s_breadth"]) and low(r["u_xny"], p["u_confirm_xny"]) and low(r["u_breadth"], p["u_confirm_breadth"])
                and high(r["xny_ratio"], p["max_xny_ratio"]) and high(r["breadth_ratio"], p["max_breadth_ratio"]))]
            n, tp, truth = len(ok), sum(r["label"] for r in ok), sum(r["label"] for r in own) + 2
            assert got[s, k] == (n, tp, truth - tp)
            f1s.append(2 * tp / (n + truth) if tp else 0.0)
            errors.append(n - tp + truth - tp)
        means[k] = (-round(float(np.mean(f1s)), 12), round(float(np.mean(errors)), 9), k)
    assert len(got) == 3 * 864 and N.best_rule(scored).first().param_id == min(means.values())[2]


def test_models_of_held_out_samples_equal_plain_ridges(spark):
    dice = np.random.default_rng(4)
    x = dice.normal(size=(120, 3)) * [1, 20, 0.1] + [0, 5, 2]
    y = np.maximum(0.02 * x[:, 0] + 0.001 * x[:, 1] + dice.normal(size=120) * 0.01, 0)
    sample = dice.integers(0, 4, 120)
    frame = spark.createDataFrame([(f"s{s}", *map(float, r), float(t)) for s, r, t in zip(sample, x, y, strict=True)], "sample string, a double, b double, c double, t double").repartition(3)
    got = {(r["sample"], r.model, r.target_mode, r.weight_mode): r for r in N.leave_one_out(frame, ["a", "b", "c"], "t").collect()}
    to = {"raw": lambda v: v, "sqrt": np.sqrt, "log100": lambda v: np.log1p(100 * v), "log1000": lambda v: np.log1p(1000 * v)}
    back = {"raw": lambda v: v, "sqrt": np.square, "log100": lambda v: np.expm1(v) / 100, "log1000": lambda v: np.expm1(v) / 1000}
    weights = {"none": np.ones_like, "positive5": lambda v: np.where(v > 0, 5.0, 1.0), "abundance": lambda v: 1 + 200 * v}
    assert len(got) == 4 * 2 * 4 * 3
    for (s, model, target, weight), r in got.items():
        own = sample == int(s[1])
        mean, scale = x[~own].mean(0), x[~own].std(0)
        z, w, t = (x - mean) / scale, weights[weight](y[~own]), to[target](y[~own])
        middle, level = np.average(z[~own], axis=0, weights=w), np.average(t, weights=w)
        centred = z[~own] - middle
        beta = np.linalg.solve((centred * w[:, None]).T @ centred + N.PENALTIES[model] * np.eye(3), (centred * w[:, None]).T @ (t - level))
        p = np.maximum(back[target](level + (z[own] - middle) @ beta), 0)
        assert r.n == own.sum() and abs(r.mae - np.abs(p - y[own]).mean()) < 1e-9 and abs(r.rmse - np.sqrt(((p - y[own]) ** 2).mean())) < 1e-9
        assert abs(r.l1_points - 100 * np.abs(p / p.sum() - y[own] / y[own].sum()).sum()) < 1e-6
    assert N.leave_one_out(frame.where("sample = 's1'"), ["a"], "t").count() == 0


@pytest.mark.parametrize(
    "name, column",
    [("sparse_edges", "xny"), ("connected_components", "component"), ("representatives", "size"), ("greedy_dedup", "removed"), ("dedup_plan", "rule"), ("ctx_markerdb", "gid"), ("small_marker_report", "n_markers"), ("nominated_pair_features", "xny"), ("identity_cut_report", "xny"),
     ("default_calls", "call"), ("adaptive_gate", "called"), ("candidate_rescue_emitted", "rescued"), ("identity_report", "Confidence"), ("profile_by_probability", "called")],
)
def test_verdicts_vary_on_the_given_tables(spark, name, column):
    assert QUERIES[name](spark, SF).select(column).distinct().limit(2).count() == 2


def test_inputs_of_trees_are_the_same_as_columns_and_as_arrays(spark):
    rows = [(x, a, f, d, 2 * d, d // 2) for x in (0, 1, 50) for a in (0.5, 0.97, 1.2) for f in (0.0, 0.1, 0.2, 0.49, 0.5, 1.0) for d in (0, 3)]
    frame = spark.createDataFrame(rows, "xny long, ani double, af_ref double, n_diff_obj long, n_diff_section long, n_mut2 long")
    got = np.array(frame.select(*[c.alias(n) for n, c in trees.feature_columns(200).items()]).collect())
    assert np.allclose(got, trees.features(frame.toPandas(), 200))


def test_running_sums_and_medians_equal_plain_ones(spark):
    dice = random.Random(5)
    for n in (0, 1, 2, 7, 200):
        values = [round(dice.gauss(0, 3), 1) for _ in range(n)]
        frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        assert median(frame, "v").first()[0] == (float(np.median(values)) if n else None)
        rows = with_running_sum(frame.groupBy("v").agg(F.count("*").alias("k")), [F.col("v")], "k", "upto").collect()
        assert {r.v: r.upto for r in rows} == {v: sum(x <= v for x in values) for v in values}


def test_rows_that_stand_for_several_are_fitted_as_those(spark):
    """Also where fewer than five rows are five times or more."""
    rng = np.random.default_rng(8)
    x, y = rng.random(60), rng.random(60)
    rows = [(float(a), float(b), float(a > 0.9) + float(b), int(t)) for a, b, t in zip(x, y, rng.integers(1, 9, 60), strict=True)]
    frame = spark.createDataFrame(rows, "x double, y double, label double, times int")
    every = frame.select("x", "y", "label", F.explode(F.sequence(F.lit(1), "times")))
    inputs = np.stack([x, y], 1)
    got, want = (trees.predict(M.fit_regression(f, ["x", "y"], "label", rounds=3, **more), inputs) for f, more in ((frame, {"times": "times"}), (every, {})))
    assert np.allclose(got, want) and len(set(got.round(6))) > 5
