"""Lists of shared contexts, against a row for each of them."""

import random

import pytest
from pyspark.sql import functions as F

from sketchlake import queries as Q
from sketchlake import report_queries as Z
from sketchlake import sequence_queries as S  # noqa: F401  (adds its queries)
from sketchlake.operators import composite as V
from sketchlake.operators import pairs as P
from sketchlake.operators import readwise as R
from sketchlake.operators import sketch as K

SF = "/root/testdata/sf0.001"


@pytest.fixture
def entries(spark, monkeypatch):
    """A context that all samples have, conflicts, and samples that share nothing; lists of two and several tasks."""
    monkeypatch.setattr(P, "LISTED", 2)
    monkeypatch.setattr(P, "TASK_SHARED", 20)
    rng = random.Random(8)
    rows = {(g, 0, 5 * g) for g in range(9)} | {(rng.randrange(9), rng.randrange(1, 14), rng.randrange(1 << 8)) for _ in range(90)} | {(70, 99, 1), (71, 98, 1)}
    return spark.createDataFrame(sorted(rows), "gid long, hctx long, obj int")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("noted", [1 << 20, 3])
def test_features_from_lists_are_those_of_single_contexts(entries, monkeypatch, noted):
    monkeypatch.setattr(P, "NOTED", noted)
    clean = K.drop_conflicts(entries)
    notes = P.context_counts(entries).select("gid", (F.col("gid") * 3).alias("x"))
    got, want = P.list_features(clean, notes), P.features(P.matches(clean, clean, triangle=True), P.context_counts(clean))
    assert rows_of(got.drop("x_qry", "x_ref")) == rows_of(want) != [] and got.where("x_qry <> 3 * qry or x_ref <> 3 * ref").isEmpty()
    both = P.features(P.matches(clean, clean).where("qry <> ref"), P.context_counts(clean))
    assert rows_of(P.list_features(clean, others=True)) == rows_of(both)


def test_features_from_lists_take_the_nearest_object(entries):
    clean = K.drop_conflicts(entries)
    want = P.features(P.matches(entries, clean, conflicts=True).where("qry <> ref"), P.context_counts(entries), P.context_counts(clean))
    assert rows_of(P.list_features(entries, others=True, conflicts=True)) == rows_of(want) != []


@pytest.mark.parametrize("k", [1, 5, 6, 50])
def test_a_sketch_with_its_densities_is_that_of_both_operators(spark, k):
    rows = K.hashed(Z.related_lines(spark, SF), "gid", "l_partkey", "obj").union(spark.createDataFrame([(900, h, 1) for h in range(6)], "gid long, hctx long, obj int"))
    whole = rows.groupBy("gid", "hctx", "obj").agg(F.count("*").alias("cnt"))
    sketch, densities = K.build_with_densities(rows, k)
    assert rows_of(sketch) == rows_of(K.build(whole, k).select("gid", "hctx", "obj"))
    assert rows_of(densities) == rows_of(K.context_densities(whole, k).select("gid", "threshold", "estimate_post")) != []


def test_reports_deal_lists_not_single_contexts(spark):
    for name in ("identity_report", "identity_report_raw", "identity_report_reads", "identity_report_if_far"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate inline") < plan.index("hashpartitioning(qry")  # what stands above comes later


def test_read_contexts_are_explained_without_candidates(spark, monkeypatch):
    reads = spark.createDataFrame([(1, 10, 0), (1, 10, 3), (2, 10, 0), (1, 11, 0), (3, 12, 0), (3, 99, 0)], "unit long, hctx long, obj int")
    ref = spark.createDataFrame([(5, 10, 0), (6, 10, 1), (6, 12, 1), (6, 50, 0)], "gid long, hctx long, obj int")
    density = spark.createDataFrame([(5, 0.5), (6, 0.25)], "gid long, density double")
    want = (5, 3, 2 + 2 + 4.0, 0.0)
    assert tuple(R.unknown_fraction(ref, reads, density, 1.0).first()) == want
    assert tuple(R.unknown_fraction(ref, reads, density, 0.25).first()) == (5, 3, 3.0, 0.4)
    assert tuple(R.unknown_fraction(ref, reads.where("unit > 9"), density, 1.0).first()) == (0, 0, 0.0, 0.0)

    def refuse(*_):
        raise AssertionError("every reference of every read context would be dealt")

    monkeypatch.setattr(R, "candidates", refuse)
    assert Q.QUERIES["unknown_fraction"](spark, SF).first()["observed"] > 0


@pytest.mark.parametrize("measure", ["cosine", "l1", "l2"])
def test_search_in_blocks_is_that_over_all_pairs(spark, monkeypatch, measure):
    """Blocks of two queries, a dimension that all have and some that one side only has; an index that isn't the queries."""
    monkeypatch.setattr(V, "BLOCK_MOST", 2)
    monkeypatch.setattr(V, "BLOCK_LEAST", 1)
    rng = random.Random(2)
    side = lambda n, low: {(3 * i + low): {0: 1 + rng.random(), **{rng.randrange(1, 12): 5 * rng.random() for _ in range(4)}} for i in range(n)} | {90 + low: {77 + low: 1.0}}
    queries, index = side(7, 0), side(5, 1)
    frame = lambda x: spark.createDataFrame([(g, k, v) for g, of in x.items() for k, v in of.items()], "sample long, dim long, pct double")
    got = {(r["qry"], r["ref"]): r["value"] for r in V.search(frame(queries), frame(index), measure).collect()}
    norm = lambda a: sum(v * v for v in a.values()) ** 0.5
    want = {}
    for q, a in queries.items():
        for r, b in index.items():
            if both := set(a) & set(b):
                gaps = [a[k] - b[k] for k in both]
                want[q, r] = {"cosine": sum(a[k] * b[k] for k in both) / norm(a) / norm(b), "l1": sum(map(abs, gaps)) + 200 - sum(a[k] + b[k] for k in both), "l2": sum(x * x for x in gaps) ** 0.5}[measure]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) == 35


def test_searches_sum_up_products_where_they_are_made(spark):
    for name in ("cosine_search", "l1_search", "l2_search"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(qry" not in plan and "hashpartitioning(_block" in plan


def test_abundance_from_lists_is_that_of_single_contexts(spark, monkeypatch):
    monkeypatch.setattr(P, "LISTED", 2)
    rng = random.Random(6)
    query = [(g, h, rng.randrange(1, 9)) for g in range(4) for h in range(30) if rng.random() < 0.6]
    ref = [(g, h) for g in range(20, 25) for h in range(30) if rng.random() < 0.5]
    got = {(r["qry"], r["ref"]): (r["n"], r["mean"], r["median"], r["max"]) for r in V.species_abundance(spark.createDataFrame(query, "gid long, hctx long, cnt long"), spark.createDataFrame(ref, "gid long, hctx long")).collect()}
    want = {}
    for q in range(4):
        for r in range(20, 25):
            found = sorted(c for g, h, c in query if g == q and (r, h) in ref)
            if len(found) >= V.MIN_SHARED:
                want[q, r] = (len(found), pytest.approx(sum(found) / len(found)), found[len(found) // 2], found[-1])
    assert got == want != {}


def test_a_sketch_of_rows_is_that_of_their_entries(spark):
    rows = K.hashed(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_suppkey", "l_partkey", "l_quantity")
    whole = K.entries(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_suppkey", "l_partkey", "l_quantity")
    assert rows_of(K.build_rows(rows, 40).select("gid", "hctx", "obj", "cnt")) == rows_of(K.build(whole, 40)) != []


@pytest.mark.parametrize("name", ["ignore_conflict_features", "wide_pair_features", "matrix_full_long"])
def test_pairs_deal_lists_not_single_contexts(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("hashpartitioning(qry")
