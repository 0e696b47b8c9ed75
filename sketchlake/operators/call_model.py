"""Call probability learned from labelled features: a forest and boosted trees.

Spark's own trainers fit both, from histograms aggregated over the executors. What they learned is read
back as tables of nodes and kept as a bundle: a JSON text of a few hundred nodes with the columns and
the training pool and scope that it is valid for. A bundle becomes one SQL expression, so
that prediction is a projection within codegen, wherever the model came from.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlake.operators.calibrate import MEASURES
from sketchlake.session import checkpoint, shared_folder

VERSION = 1
#: The joined features that the models use, in order.
COLUMNS = tuple(f"{p}_{m}" for p in "us" for m in (*MEASURES[:6], "depth_cv_min", *MEASURES[7:], "rows", "direct")) + ("xny_ratio", "breadth_ratio", "ani_delta")
#: The model that comes with the package, fitted by ``fit`` to the queries' species of the largest test table.
BUNDLED = Path(__file__).resolve().parents[1] / "models" / "calls.json"


def training_rows(features: DataFrame, truth: DataFrame, key: str = "taxid", scopes: DataFrame | None = None, scope: str = "all") -> DataFrame:
    """Features with ``label`` 1 where the key is true, else 0; with ``scopes`` (key, scope), only those of the scope.

    Without rows of both labels nothing can be learned, which is an error.
    """
    rows = features.join(truth.select(key, F.lit(1.0).alias("_true")).distinct(), key, "left").withColumn("label", F.coalesce("_true", F.lit(0.0))).drop("_true")
    if scopes is not None and scope != "all":
        own = F.col("scope").isin("bacteria", "archaea") if scope == "prokaryote" else F.col("scope") == scope
        rows = rows.join(scopes.where(own).select(key).distinct(), key, "left_semi")
    found = {r["label"] for r in rows.select("label").distinct().collect()}
    if found != {0.0, 1.0}:
        raise ValueError("training needs positive and negative labels within the scope")
    return rows


def _trees(spark: SparkSession, model, columns: Sequence[str], value) -> list[dict]:
    """The nodes of a fitted ensemble as lists; ``value`` says what a leaf gives."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    trees: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():  # as many nodes as the ensemble's parameters allow
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    out = []
    for _, nodes in sorted(trees.items()):
        place = {number: i for i, number in enumerate(sorted(nodes))}
        tree: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
        for number in sorted(nodes):
            node = nodes[number]
            inner = node["leftChild"] >= 0
            for k, v in (
                ("feature", node["split"]["featureIndex"] if inner else -1), ("threshold", node["split"]["leftCategoriesOrThreshold"][0] if inner else 0.0),
                ("left", place[node["leftChild"]] if inner else 0), ("right", place[node["rightChild"]] if inner else 0), ("value", 0.0 if inner else value(node)),
            ):
                tree[k].append(v)
        out.append(tree)
    return out


def _assembled(rows: DataFrame, columns: Sequence[str], label: str, more: Sequence[str] = ()) -> tuple[DataFrame, dict[str, float]]:
    """Vectors of the columns, missing values at the median, which is returned."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    middle = rows.agg(*[F.percentile_approx(known(c), 0.5, 10000).alias(c) for c in columns]).first()
    medians = {c: float(middle[c] or 0.0) for c in columns}
    filled = rows.select(*[F.coalesce(known(c), F.lit(medians[c])).alias(c) for c in columns], F.col(label).cast("double").alias("_label"), *more)
    return VectorAssembler(inputCols=list(columns), outputCol="_x").transform(filled), medians


def fit(rows: DataFrame, pool: str, scope: str = "all", filtered: bool = False, columns: Sequence[str] = COLUMNS, trees: int = 20, depth: int = 4, rounds: int = 20, rate: float = 0.1, leaf: int = 3, seed: int = 17) -> dict:
    """A bundle of a forest, whose classes weigh alike, and boosted trees, fitted to rows with ``label`` 0 or 1."""
    spark = rows.sparkSession
    data, medians = _assembled(rows, columns, "label")
    data = checkpoint(data)
    share = data.agg(F.avg("_label").alias("p")).first()["p"]
    weighted = data.withColumn("_w", F.when(F.col("_label") == 1, F.lit(0.5 / share)).otherwise(F.lit(0.5 / (1 - share))))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(weighted)
    boosted = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=rounds, maxDepth=max(1, depth - 1), stepSize=rate, minInstancesPerNode=leaf, seed=seed).fit(data)
    parts = [
        {"kind": "forest", "trees": _trees(spark, forest, columns, lambda n: n["impurityStats"][1] / sum(n["impurityStats"]))},
        {"kind": "boosted", "weights": list(boosted.treeWeights), "trees": _trees(spark, boosted, columns, lambda n: n["prediction"])},
    ]
    return {"version": VERSION, "columns": list(columns), "medians": medians, "models": parts, "metadata": {"pool": pool, "scope": scope, "filtered": filtered}}


def fit_regression(rows: DataFrame, columns: Sequence[str], label: str, rounds: int = 20, depth: int = 3, rate: float = 0.1, seed: int = 17, times: str | None = None) -> dict:
    """Boosted trees for a number, as an ensemble of ``functions.trees``; fitted over all rows where they are. A row may stand for as many as its ``times``."""
    data, _ = _assembled(rows, columns, label, [F.col(times).cast("double").alias("_w")] if times else [])
    data = checkpoint(data)
    trainer = GBTRegressor(featuresCol="_x", labelCol="_label", maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=5, seed=seed)
    if times:  # five rows are five times
        whole = data.agg(F.sum("_w").alias("n")).first()["n"] or 0.0
        trainer = trainer.setWeightCol("_w").setMinInstancesPerNode(1).setMinWeightFractionPerNode(min(5 / max(whole, 1.0), 0.49))
    model = trainer.fit(data)
    trees = _trees(rows.sparkSession, model, columns, lambda n: n["prediction"])
    for tree, weight in zip(trees, model.treeWeights, strict=True):
        tree["value"] = [v * weight for v in tree["value"]]
    return {"baseline": 0.0, "trees": trees}


def check(bundle: object, pool: str | None = None, scope: str | None = None, filtered: bool | None = None, columns: Sequence[str] = COLUMNS) -> dict:
    """The bundle if it is one, of this version and these columns, fitted for what is asked; else an error that says what differs."""
    if not isinstance(bundle, dict) or not isinstance(bundle.get("models"), list) or [m.get("kind") for m in bundle["models"]] != ["forest", "boosted"]:
        raise ValueError("a model file holds a forest and boosted trees")
    if bundle.get("version") != VERSION:
        raise ValueError(f"unsupported version of a model file: {bundle.get('version')!r}")
    if bundle.get("columns") != list(columns):
        raise ValueError("the model file was fitted to other columns")
    for name, asked in (("pool", pool), ("scope", scope), ("filtered", filtered)):
        held = bundle.get("metadata", {}).get(name)
        if asked is not None and held != asked:
            raise ValueError(f"the model file's {name} is {held!r}, not {asked!r}")
    return bundle


def save(spark: SparkSession, bundle: dict, path: str) -> None:
    """Writes a new folder with the bundle as one text; any store that Spark writes."""
    spark.createDataFrame([(json.dumps(bundle),)], "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str, **asked) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"not a model file: {path}")
    try:
        return check(json.loads(rows[0]["value"]), **asked)
    except json.JSONDecodeError as error:
        raise ValueError(f"not a model file: {path}") from error


def cache_names(folder: str, pool: str, scope: str, filtered: bool) -> list[str]:
    """Where a fitted model may lie, the most special first."""
    tag = scope if filtered else "unfiltered"
    return [f"{folder.rstrip('/')}/{name}" for name in (f"calls.{pool}.{tag}", f"calls.{pool}", "calls")]


def load_or_fit(spark: SparkSession, folder: str | None, rows, pool: str, scope: str = "all", filtered: bool = False, write: bool = False, **options) -> dict:
    """The first model file found under ``folder``; without one, a model fitted to ``rows()``, written there if asked.

    A file that is there but doesn't hold for what is asked is an error, never passed over.
    """
    names = cache_names(folder, pool, scope, filtered) if folder else []
    for name in names:
        try:
            return load(spark, name, pool=pool, scope=scope, filtered=filtered, columns=options.get("columns", COLUMNS))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
    bundle = fit(rows(), pool, scope, filtered, **options)
    if write and names:
        save(spark, bundle, names[0])
    return bundle


def bundled() -> dict:
    return check(json.loads(BUNDLED.read_text()))


def _tree_sql(tree: dict, columns: Sequence[str], medians: dict, at: int = 0) -> str:
    if tree["feature"][at] < 0:
        return f"CAST({tree['value'][at]!r} AS DOUBLE)"
    name = columns[tree["feature"][at]]
    below = f"coalesce(CAST({name} AS DOUBLE), {medians[name]!r}) <= CAST({tree['threshold'][at]!r} AS DOUBLE)"
    return f"CASE WHEN {below} THEN {_tree_sql(tree, columns, medians, tree['left'][at])} ELSE {_tree_sql(tree, columns, medians, tree['right'][at])} END"


def probability_sql(bundle: dict) -> str:
    """The mean of the forest's share of votes and the boosted trees' logistic, over columns by name; an expression that any SQL engine takes."""
    forest, boosted = bundle["models"]
    text = lambda tree: _tree_sql(tree, bundle["columns"], bundle["medians"])
    votes = " + ".join(text(t) for t in forest["trees"])
    margin = " + ".join(f"CAST({w!r} AS DOUBLE) * ({text(t)})" for w, t in zip(boosted["weights"], boosted["trees"], strict=True))
    return f"(0.5 * ({votes}) / {len(forest['trees'])} + 0.5 / (1 + exp(-2 * ({margin}))))"


def probability(bundle: dict) -> Column:
    return F.expr(probability_sql(bundle))
