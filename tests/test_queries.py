"""Registered queries against their SQL."""

import collections
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
import sketchlake.report_queries  # noqa: F401  (adds its queries)
from sketchlake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["sketch_counts", "weighted_percentile_cutoff", "ctx_density_estimate", "pair_features_conflict_min", "ctx_moe_distance", "topn_per_query", "connected_components", "pairwise_ctx_markerdb", "best_diff_split", "depth_abundance", "topfrac_median", "zip_af", "lca", "adaptive_gate", "composite_abundance", "identity_report", "profile_report", "read_track_report", "read_track_summary", "latent_solvers", "profile_universal", "best_threshold"]


def rounded(rows):
    return collections.Counter(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_its_sql(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = connection.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rounded(tuple(r[c] for c in columns) for r in frame.collect()) == rounded(tuple(r[i] for i in at) for r in found.fetchall())


def test_every_oracle_has_its_query_and_the_flagship_gives_rows(spark):
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["composite_abundance", "cosine_search", "l1_search", "l2_search", "matrix_full_long", "normalized_abundance"])
def test_query_agrees_with_its_sql_over_all_samples(spark, name):
    """On sf0.01 with its 100 samples."""
    sf = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rows = QUERIES[name](spark, sf)
    columns = rows.columns
    got = [tuple(r) for r in rows.collect()]
    found = connection.execute(f"select {', '.join(columns)} from ({ORACLES[name]})")
    assert rounded(got) == rounded(found.fetchall())
    assert max(r[0] for r in got) > 60 and {r[0] % 2 for r in got} == {0, 1}


def test_the_entry_is_imported_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).stdout.split() == ["True", "True"]
