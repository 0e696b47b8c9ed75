"""Matching of reads without holding their candidates, against the windows over all candidates."""

import random

import pytest

from sketchlake import queries as Q
from sketchlake.operators import calibrate as C
from sketchlake.operators import evidence as E
from sketchlake.operators import readwise as R


@pytest.fixture(scope="module")
def sides(spark):
    """Reads with up to four objects in a context, and references with conflicts."""
    rng = random.Random(5)
    reads = [(rng.randrange(40), rng.randrange(12), rng.randrange(1 << 8)) for _ in range(400)]
    ref = sorted({(rng.randrange(9), rng.randrange(10), rng.randrange(1 << 8)) for _ in range(90)})
    return spark.createDataFrame(reads, "unit long, hctx long, obj int"), spark.createDataFrame(ref, "gid long, hctx long, obj int")


@pytest.mark.parametrize("mode", R.MODES)
def test_matched_reads_are_those_of_windows_over_candidates(sides, mode):
    reads, ref = sides
    columns = ["unit", "hctx", "gid", "d", "best", "n_candidates", "n_best", "inc"]
    got, want = R.matched(reads, ref, mode), R.assign(R.candidates(reads, ref), mode)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []
    assert sorted(map(tuple, R.support(got).collect())) == sorted(map(tuple, R.support(want).collect()))


def test_traces_of_matched_reads_and_of_candidates_are_equal(sides):
    reads, ref = sides
    found, marked = R.candidates(reads, ref), R.matched(reads, ref, "all")
    assert sorted(map(tuple, E.traced(marked, "best-diff-split").collect())) == sorted(map(tuple, E.edge_trace(found, "best-diff-split").collect()))
    assert sorted(map(tuple, E.traced_reference(reads, ref, 3, "best-diff").collect())) == sorted(map(tuple, E.reference_trace(found, 3, "best-diff").collect()))


def test_candidates_are_neither_sorted_nor_dealt_again(spark):
    """Sums per context follow the join where it is; only reads and references are shuffled, and no window runs over candidates."""
    plan = R.coverage(Q.assigned(spark, "/root/testdata/sf0.001", "best-diff-split"))._jdf.queryExecution().executedPlan().toString()
    assert "Window [min(d" not in plan and "hashpartitioning(unit" not in plan and "hashpartitioning(gid" not in plan


@pytest.mark.parametrize("mode", R.MODES)
def test_coverage_by_classes_of_reads_is_that_of_reads(sides, mode):
    reads, ref = sides
    assert sorted(map(tuple, R.covered(reads, ref, mode).collect())) == sorted(map(tuple, R.coverage(R.matched(reads, ref, mode)).collect())) != []


def test_tasks_of_the_matching_grow_with_the_references(sides, monkeypatch):
    reads, ref = sides
    want = sorted(map(tuple, R.covered(reads, ref, "best-diff-split").collect()))
    monkeypatch.setattr(R, "TASK_CONTEXTS", 8, raising=False)
    assert R.classes(reads, ref)[1].rdd.getNumPartitions() == -(-ref.count() // 8) > 4
    assert sorted(map(tuple, R.covered(reads, ref, "best-diff-split").collect())) == want


def test_shares_by_contexts_are_those_over_written_candidates(spark, sides):
    reads, ref = sides
    marker = spark.createDataFrame([(g, float(g)) for g in range(8)], "gid long, share double")
    got = {r["gid"]: r["share"] for r in C.context_em(reads, ref, marker, alpha=0.7, iterations=3).collect()}
    want = {r["gid"]: r["share"] for r in C.ambiguity_em(R.ambiguity_edges(R.matched(reads, ref, "all")), marker, alpha=0.7, iterations=3).collect()}
    assert got == pytest.approx(want) and len(set(got.values())) > 3
