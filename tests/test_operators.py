"""Operators against plain Python on small random tables."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchlake.functions import distance as D
from sketchlake.functions import kmers, reads_qc, trees
from sketchlake.functions.hashing import SEED, hash_contexts
from sketchlake.operators import calibrate as C
from sketchlake.operators import clusters as G
from sketchlake.operators import pairs as P
from sketchlake.operators import readwise as R
from sketchlake.operators import setops as S
from sketchlake.operators import sketch as K
from sketchlake.operators import taxonomy as T

M = (1 << 64) - 1


def mix(x):
    x = (x + SEED) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def test_hash_is_the_same_in_columns_numpy_and_python_whatever_the_arithmetic_mode(spark):
    values = [0, 1, 5, 12345678901, 2**44 - 1, -7]
    rows = hash_contexts(spark.createDataFrame([(v,) for v in values], "ctx long"), "ctx").collect()
    want = [mix((v & M) ^ SEED) >> 20 for v in values]
    assert [r["hctx"] for r in rows] == want
    got = kmers.mix64(np.array([v & M for v in values], np.uint64) ^ kmers.SEED) >> np.uint64(20)
    assert got.astype(np.int64).tolist() == want
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def sketch_rows(spark, seed=1, samples=6, contexts=40):
    dice = random.Random(seed)
    rows = {(g, dice.randrange(contexts), dice.randrange(16)) for g in range(samples) for _ in range(30)}
    return sorted(rows), spark.createDataFrame([(g, h, o, 1) for g, h, o in sorted(rows)], "gid long, hctx long, obj int, cnt long")


def bases(x, y):
    z = x ^ y
    return bin((z | z >> 1) & 0x55555555).count("1")


def test_build_drops_conflicts_then_cuts(spark):
    rows, frame = sketch_rows(spark)
    got = {tuple(r)[:3] for r in K.build(frame, 7).collect()}
    want = set()
    for g in range(6):
        own = [r for r in rows if r[0] == g]
        n = collections.Counter(h for _, h, _ in own)
        want |= set(sorted(r for r in own if n[r[1]] == 1)[:7])
    assert got == want
    assert {tuple(r)[:3] for r in K.build(frame, 7, conflict=True).collect()} == {r for g in range(6) for r in sorted(x for x in rows if x[0] == g)[:7]}


def test_features_take_the_smallest_distance_of_conflicting_objects(spark):
    rows, frame = sketch_rows(spark)
    got = {(r["qry"], r["ref"]): (r["xny"], r["n_diff_obj"], r["n_diff_section"], r["n_mut2"]) for r in P.features(P.matches(frame, frame, True, True), P.context_counts(frame)).collect()}
    of = collections.defaultdict(lambda: collections.defaultdict(list))
    for g, h, o in rows:
        of[g][h].append(o)
    for q in of:
        for r in of:
            if r < q:
                d = [min(bases(a, b) for a in of[q][h] for b in of[r][h]) for h in of[q] if h in of[r]]
                if d:
                    assert got[q, r] == (len(d), sum(x > 0 for x in d), sum(d), sum(x > 1 for x in d))


def test_identical_samples_have_no_distance_and_no_markers(spark):
    _, frame = sketch_rows(spark, samples=1)
    both = frame.union(frame.withColumn("gid", F.lit(1).cast("long")))
    row = P.features(P.matches(K.build(both, 31), K.build(both, 31), True), P.context_counts(K.build(both, 31))).select(*[c.alias(n) for n, c in P.metric_columns(31).items()]).first()
    assert all(abs(v) < 1e-12 for v in row)
    assert S.markers(both).isEmpty() and S.context_markers(both).isEmpty()


def test_downsampling_equals_a_direct_sketch(spark):
    _, frame = sketch_rows(spark)
    assert sorted(map(tuple, S.downsample(K.build(frame, 20), 5, 20).collect())) == sorted(map(tuple, K.build(frame, 5).collect()))
    with pytest.raises(ValueError):
        S.downsample(frame, 30, 20)


def graph(seed, n=14, p=0.16):
    dice = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a) if dice.random() < p], n


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_is_the_first_independent_set_and_full_linkage_gives_cliques(spark, seed):
    edges, n = graph(seed)
    dice = random.Random(seed)
    quality = [(g, dice.randrange(3) * 100, bool(dice.randrange(2)), 0.5, dice.randrange(3), 10, 0.1, dice.randrange(4)) for g in range(n)]
    samples = spark.createDataFrame(quality, "gid long, total_bp long, is_fasta boolean, asm_level double, n_records long, median_bp long, len_cv double, n_entries long")
    frame = spark.createDataFrame(edges, "a long, b long")
    order = [r["gid"] for r in G.with_rank(samples).orderBy("place").collect()]
    key = lambda q: (q[1] <= 0, *((not q[2], -q[3], -q[1], q[4] or 99, -q[5], q[6]) if q[1] else (0,) * 6), -q[7], q[0])
    assert order == [q[0] for q in sorted(quality, key=key)]
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    keeper = {}
    for g in order:
        if g not in keeper:
            keeper[g] = g
            for o in near[g]:
                keeper.setdefault(o, g)
    assert {r["gid"]: r["representative"] for r in G.greedy(samples, frame).collect()} == keeper
    linked, members = {}, {}
    for g in order:
        if g in linked:
            continue
        linked[g], members[g] = g, [g]
        for o in order:
            if o not in linked and all(o in near[m] for m in members[g]):
                linked[o] = g
                members[g].append(o)
    assert {r["gid"]: r["representative"] for r in G.full_linkage(samples, frame).collect()} == linked
    plan = {r["gid"]: r for r in G.dedup_plan(samples, G.greedy(samples, frame)).collect()}
    assert sum(r["kept"] for r in plan.values()) == len(set(keeper.values())) and plan[order[0]]["rule"] == "representative"


@pytest.mark.parametrize("size", [9, 40])
def test_full_linkage_settles_ranges_as_the_whole_order(spark, size):
    edges, n = graph(7, 40, 0.4)
    samples = spark.createDataFrame([(g, 100, True, 0.5, 1, 10, 0.1, 1) for g in range(n)], "gid long, total_bp long, is_fasta boolean, asm_level double, n_records long, median_bp long, len_cv double, n_entries long")
    near = {(x, y) for a, b in edges for x, y in ((a, b), (b, a))}
    cliques = []
    for g in range(n):  # the lower id is better
        owner = next((c for c in cliques if all((g, m) in near for m in c)), None)
        cliques.append([g]) if owner is None else owner.append(g)
    assert {len(c) for c in cliques} >= {1, 2, 3}
    found = G.full_linkage(samples, spark.createDataFrame(edges, "a long, b long"), size)
    assert {r["gid"]: r["representative"] for r in found.collect()} == {g: c[0] for c in cliques for g in c}


def test_full_linkage_has_few_rounds_where_each_sample_waits_for_the_one_before(spark, monkeypatch):
    written = []
    monkeypatch.setattr(G, "checkpoint", lambda frame, f=G.checkpoint: written.append(1) or f(frame))
    samples = spark.createDataFrame([(g, 100, True, 0.5, 1, 10, 0.1, 1) for g in range(24)], "gid long, total_bp long, is_fasta boolean, asm_level double, n_records long, median_bp long, len_cv double, n_entries long")
    found = G.full_linkage(samples, spark.createDataFrame([(g, g + 1) for g in range(23)], "a long, b long"))
    assert {r["gid"]: r["representative"] for r in found.collect()} == {g: g // 2 * 2 for g in range(24)} and len(written) <= 4


def test_components_settle_on_paths_and_lone_samples(spark):
    samples = spark.createDataFrame([(i,) for i in range(12)], "gid long")
    found = {r["gid"]: r["component"] for r in G.components(samples, spark.createDataFrame([(i, i + 1) for i in range(8)] + [(10, 9)], "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(9)}, 9: 9, 10: 9, 11: 11}


def test_split_increments_and_the_unique_sidecar(spark):
    ref = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 0), (0, 2, 0), (1, 2, 3)], "gid long, hctx long, obj int")
    reads = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, 2, 0), (9, 2, 1)], "unit long, hctx long, obj int")
    found = R.candidates(reads, ref)
    split = {(r["unit"], r["gid"]): r["inc"] for r in R.assign(found, "best-diff-split").collect()}
    assert split == {(7, 0): 341, (7, 1): 341, (7, 2): 341, (8, 0): 1024, (9, 0): 512, (9, 1): 512}
    unique = sorted((r["unit"], r["gid"]) for r in R.assign(found, "best-diff-unique").collect())
    assert unique == [(8, 0)] == sorted((r["unit"], r["gid"]) for r in R.assign(found, "best-diff-split").where("n_best = 1").collect())


def test_latent_breadth_solves_its_equation(spark):
    rows = spark.createDataFrame([(0.3, 2.0), (0.5, 0.6), (0.0, 1.0), (1.0, 5.0), (0.2, 0.1)], "b double, m double")
    for r in rows.withColumn("pi", D.latent_breadth(F.col("b"), F.col("m"))).collect():
        if 0 < r["b"] < 1 and r["pi"] not in (r["b"], 1.0):
            assert abs(r["pi"] * (1 - math.exp(-r["m"] / r["pi"])) - r["b"]) < 1e-9


def test_tails():
    lam, k = 2.5, 4
    tail = 1 - sum(math.exp(-lam) * lam**i / math.factorial(i) for i in range(k))
    assert abs(R.poisson_tail(np.array([k]), np.array([lam]))[0] + math.log10(tail)) < 1e-12
    assert R.poisson_tail(np.array([0, 5, 2000]), np.array([1.0, 0.0, 1.0])).tolist() == [0.0, 16.0, 16.0]
    m, v = 3.0, 9.0
    size = m * m / (v - m)
    p = size / (size + m)
    pmf = [math.exp(math.lgamma(i + size) - math.lgamma(size) - math.lgamma(i + 1) + size * math.log(p) + i * math.log1p(-p)) for i in range(k)]
    want = -math.log10((1 - sum(pmf)) / (1 - pmf[0]))
    assert abs(R.negative_binomial_tail(np.array([k]), np.array([m]), np.array([v]))[0] - want) < 1e-9
    assert R.negative_binomial_tail(np.array([k]), np.array([lam]), np.array([1.0]))[0] == R.poisson_tail(np.array([k]), np.array([lam]))[0]


def test_lineages_agree_up_to_their_common_prefix(spark):
    rows = spark.createDataFrame([(1, "A|B|C"), (1, "A|B|D"), (2, "A|B"), (2, "A|B"), (3, "A"), (3, "Z"), (4, "A|B"), (4, "NA"), (4, None), (5, "A|B|C"), (5, "A|B")], "u long, p string")
    found = {r["u"]: (r["depth"], r["rank"], r["name"]) for r in T.lca(rows, "u", "p").collect()}
    assert found == {1: (2, "phylum", "B"), 2: (2, "phylum", "B"), 3: (0, "root", "NA"), 4: (2, "phylum", "B"), 5: (2, "phylum", "B")}


def test_metric_expressions(spark):
    row = spark.createDataFrame([(0.1, 0.3, None)], "a double, b double, c double").select(
        D.metric_expression("a&b", {"a": F.col("a"), "b": F.col("b")}).alias("and_"), D.metric_expression("a|b", {"a": F.col("a"), "b": F.col("b")}).alias("or_"), D.metric_expression("a&c", {"a": F.col("a"), "c": F.col("c")}).alias("none")
    ).first()
    assert tuple(row) == (0.3, 0.1, None)
    with pytest.raises(ValueError):
        D.metric_expression("a&b|a", {"a": F.col("a"), "b": F.col("b")})


def test_mixing_layouts_or_unknown_samples_fails(spark):
    with pytest.raises(ValueError):
        S.check_compatible({"target_size": 5000}, {"target_size": 7000})
    known = spark.createDataFrame([(1,)], "gid long")
    with pytest.raises(ValueError):
        S.check_listed(known, spark.createDataFrame([(2,)], "gid long"))


def test_reverse_complement_has_the_same_contexts():
    dice = random.Random(3)
    seq = "".join(dice.choice("ACGT") for _ in range(300)) + "NNN" + "".join(dice.choice("acgt") for _ in range(100))
    back = seq.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = kmers.context_entries(seq), kmers.context_entries(back)
    assert sorted(a[0].tolist()) == sorted(b[0].tolist()) and len(a[0]) == 300 - 31 + 100 - 31
    assert len(kmers.context_entries("ACGT" * 7)[0]) == 0
    context = lambda w: "".join(c for i, c in enumerate(w) if i % 3 != 2)
    number = lambda s: int("".join(f"{'ACGT'.index(c):02b}" for c in s), 2)
    w = seq[:32]
    r = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    low = min(number(context(w)), number(context(r)))
    assert a[0][0] == mix(low ^ SEED) >> 20


def test_reads_qc_range_finds_the_peak():
    counts = np.arange(1, 60)
    freqs = 4000 * np.exp(-counts * 1.5) + 1000 * np.exp(-((counts - 30) ** 2) / 60)
    found = reads_qc.infer_range(counts, freqs.astype(int) + 1)
    assert 28 <= found.mode <= 32 and 8 <= found.lower < 26 and 34 < found.upper
    assert reads_qc.infer_range(np.array([]), np.array([])) is None


def test_trees_learn_a_step():
    x = np.random.default_rng(1).random((800, len(trees.FEATURES)))
    y = np.where(x[:, 1] > 0.5, 0.9, 0.6)
    assert np.abs(trees.predict(trees.fit_trees(x, y), x) - y).mean() < 0.01


def test_em_moves_shares_to_the_supported_reference(spark):
    edges = spark.createDataFrame([(u, 1, g, d, 0) for u in range(10) for g, d in ((0, 0), (1, 3))], "unit long, hctx long, gid long, d int, best int")
    marker = spark.createDataFrame([(0, 0.5), (1, 0.5)], "gid long, share double")
    found = {r["gid"]: r["share"] for r in C.ambiguity_em(edges, marker, alpha=1.0, iterations=5).collect()}
    assert found[0] > 0.99 and abs(sum(found.values()) - 1) < 1e-9


def test_density_blocks_follow_the_read_order(spark):
    reads = spark.createDataFrame([(0, i, n) for i, n in enumerate([60, 50, 10, 10, 90, 5])], "sample long, read_ord long, n_ctx long")
    assert [r["block"] for r in R.density_blocks(reads, 100).orderBy("read_ord").collect()] == [0, 0, 1, 1, 1, 2]


@pytest.mark.parametrize("seed", range(3, 9))
def test_a_removed_sample_goes_to_its_best_keeper(spark, seed):
    """Dense graphs, where a keeper that decides in a later round may come first in the quality order."""
    edges, n = graph(seed, 18, 0.3)
    samples = spark.createDataFrame([(g, 100 + g, True, 0.5, 1, 10, 0.1, 1) for g in range(n)], "gid long, total_bp long, is_fasta boolean, asm_level double, n_records long, median_bp long, len_cv double, n_entries long")
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    keeper = {}
    for g in range(n - 1, -1, -1):  # longest first
        if g not in keeper:
            keeper[g] = g
            for o in near[g]:
                keeper.setdefault(o, g)
    assert {r["gid"]: r["representative"] for r in G.greedy(samples, spark.createDataFrame(edges, "a long, b long")).collect()} == keeper


def test_a_long_chain_settles(spark):
    n = 60
    samples = spark.createDataFrame([(g, 1000 - g, True, 0.5, 1, 10, 0.1, 1) for g in range(n)], "gid long, total_bp long, is_fasta boolean, asm_level double, n_records long, median_bp long, len_cv double, n_entries long")
    found = G.greedy(samples, spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")).collect()
    assert {r["gid"]: r["representative"] for r in found} == {g: g - g % 2 for g in range(n)}


def test_density_blocks_of_many_ranges_equal_one_walk(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_READS", 16)
    dice = random.Random(5)
    rows = [(s, i, dice.choice([0, 3, 20, 150])) for s in (1, 2) for i in range(200) if dice.random() < 0.8]
    got = {(r["sample"], r["read_ord"]): r["block"] for r in R.density_blocks(spark.createDataFrame(rows, "sample long, read_ord long, n_ctx long"), 40).collect()}
    want, held, block, last = {}, 0, 0, None
    for s, i, n in rows:
        if s != last:
            held, block, last = 0, 0, s
        want[s, i] = block
        held += n
        if held >= 40:
            held, block = 0, block + 1
    assert got == want


def test_verified_features_of_a_lossy_nomination_are_exact(spark):
    _, frame = sketch_rows(spark, seed=4)
    clean = K.drop_conflicts(frame)
    whole = {(r["qry"], r["ref"]): tuple(r) for r in P.features(P.matches(clean, clean, triangle=True), P.context_counts(clean)).collect()}
    some = P.candidates(clean, max_frequency=3, min_votes=1)
    found = {(r["qry"], r["ref"]): tuple(r) for r in P.verified(some, clean).collect()}
    assert found and set(found) <= set(whole) and all(whole[k] == v for k, v in found.items())
    assert {(r["qry"], r["ref"]): r["votes"] for r in P.candidates(clean).collect()} == {k: v[2] for k, v in whole.items()}


def test_read_qc_runs_and_moments():
    counts = np.array([1, 2, 3, 5, 6, 9])
    assert reads_qc._run_around(counts, np.array([True] * 6), 1).tolist() == [0, 1, 2]
    assert reads_qc._run_around(counts, np.array([False] * 6), 4).tolist() == [4]
    assert reads_qc._moments(np.array([4, 4, 4]), np.array([1.0, 1.0, 1.0])) == (4.0, 0.0)


def test_full_matrix_joins_no_cells(spark, monkeypatch):
    """Pairs of samples that aren't listed, samples without pairs and blocks that end within the ids; cells come out without meeting in a join."""
    monkeypatch.setattr(P, "BLOCK_COLUMNS", 3)
    pairs = spark.createDataFrame([(5, 1, 0.25), (9, 5, 0.5), (9, 2, 0.75), (40, 1, 0.1)], "qry long, ref long, x double")
    ids = [1, 2, 3, 5, 9, 11, 12]
    matrix = P.full_matrix(pairs, spark.createDataFrame([(i,) for i in ids], "gid long"), F.col("x"))
    near = {(5, 1): 0.25, (9, 5): 0.5, (9, 2): 0.75}
    want = sorted((a, b, 0.0 if a == b else near.get((max(a, b), min(a, b)), 1.0)) for a in ids for b in ids)
    assert sorted(map(tuple, matrix.collect())) == want
    assert "LeftOuter" not in matrix._jdf.queryExecution().executedPlan().toString()
