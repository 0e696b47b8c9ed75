"""Wide layout, streamed sketches and shipped code against plain Python."""

import collections
import os
import random
import subprocess
import sys

import numpy as np
import pytest

from sketchlake.functions.kmers import Pattern, WidePattern, context_entries
from sketchlake.operators import pairs as P
from sketchlake.operators import sketch as K
from sketchlake.sources import sequences

MASK = (1 << 64) - 1


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def plain_wide(seq, codens):
    """(unsigned hash, object) of every window, one by one, with Python's own integers."""
    n, out = 3 * codens + 1, []
    number = lambda bases: int("".join("0123"["ACGT".index(c)] for c in bases) or "0", 4)
    for i in range(len(seq) - n + 1):
        w = seq[i : i + n].upper()
        if set(w) - set("ACGT"):
            continue
        both = []
        for s in (w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))):
            both.append((number("".join(c for j, c in enumerate(s) if j % 3)), number(s[::3])))
        context, obj = min(both)
        out.append((mixed(context ^ 0x9E3779B97F4A7C15), obj))
    return out


def genome(seed, n, letters="ACGT"):
    dice = random.Random(seed)
    return "".join(dice.choice(letters) for _ in range(n))


@pytest.mark.parametrize("codens", [12, 13, 14, 15])
def test_wide_windows_are_those_of_plain_integers(codens):
    unit = genome(2, 3 * codens + 1)
    for seq in (genome(1, 400), genome(3, 300, "ACGTNacgt"), "A" * 60, "", "ACG", unit + unit[::-1].translate(str.maketrans("ACGT", "TGCA"))):
        hctx, obj, _ = context_entries(seq, WidePattern(codens))
        assert list(zip(hctx.view(np.uint64).tolist(), obj.view(np.uint32).tolist(), strict=True)) == plain_wide(seq, codens)


@pytest.mark.parametrize("codens", [12, 15])
def test_wide_sketches_and_pairs_equal_plain_ones(spark, codens):
    base = genome(7, 900)
    texts = [base, base[:500] + genome(8, 300), genome(9, 700) + base[100:300], base[:450] + "T" + base[451:]]
    records = spark.createDataFrame([(g, 0, t) for g, t in enumerate(texts)], "gid long, record_ord long, seq string")
    pattern, k = WidePattern(codens), 400
    found = sequences.entries(sequences.windows(records, pattern))
    want, before = {}, {}
    for g, t in enumerate(texts):
        contexts = collections.defaultdict(set)
        for h, o in plain_wide(t, codens):
            contexts[h].add(o)
        before[g] = contexts
        want[g] = dict(sorted((h, next(iter(o))) for h, o in contexts.items() if len(o) == 1)[:k])
    sketch = K.wide_build(found, k)
    got = collections.defaultdict(dict)
    for r in sketch.collect():
        got[r.gid][r.hctx & MASK] = r.obj & 0xFFFFFFFF
    assert got == want and any(h >= 1 << 63 for h in want[0]) == (len(want[0]) < k or max(want[0]) >= 1 << 63)
    for r in P.features(P.matches(sketch, sketch, triangle=True), P.context_counts(sketch)).collect():
        shared = want[r.qry].keys() & want[r.ref].keys()
        diffs = [sum((want[r.qry][h] ^ want[r.ref][h]) >> 2 * i & 3 > 0 for i in range(16)) for h in shared]
        assert (r.xny, r.n_diff_obj, r.n_diff_section, r.n_mut2) == (len(shared), sum(d > 0 for d in diffs), sum(diffs), sum(d > 1 for d in diffs))
    for r in K.wide_densities(found, k).collect():
        clean = sorted(h for h, o in before[r.gid].items() if len(o) == 1)
        limit = MASK if len(clean) <= k else clean[k - 1]
        assert (int(r.threshold), r.observed_pre, r.observed_post) == (limit, sum(h <= limit for h in before[r.gid]), sum(h <= limit for h in clean))
    threshold = 3 << 62
    assert sequences.windows(records, pattern, threshold).count() == sum(h <= threshold for t in texts for h, _ in plain_wide(t, codens))


def conflicted(seed, n):
    """A sequence many of whose contexts come again with another object."""
    dice, unit = random.Random(seed), genome(seed, 60)
    out = []
    for _ in range(n):
        copy = list(unit if dice.random() < 0.5 else genome(dice.random(), 60))
        copy[dice.randrange(60)] = dice.choice("ACGT")
        out.append("".join(copy))
    return "N".join(out)


@pytest.mark.parametrize("pattern", [Pattern(), WidePattern(12)])
@pytest.mark.parametrize("conflict", [False, True])
def test_streamed_sketch_equals_the_full_sort(spark, pattern, conflict):
    rows = [(g, i, conflicted(10 * g + i, 30)) for g in range(4) for i in range(5)] + [(9, 0, genome(4, 50)), (10, 0, None), (11, 0, ""), (None, 0, genome(5, 90))]
    records = spark.createDataFrame(rows, "gid long, record_ord long, seq string").repartition(3)
    found = sequences.entries(sequences.windows(records, pattern))
    for k in (1, 20, 150, 5000):
        built = K.wide_bottom_k if isinstance(pattern, WidePattern) else K.bottom_k
        want = built(found if conflict else K.drop_conflicts(found), k)
        got = sequences.streamed_sketch(records, k, pattern, conflict, slack=1)
        columns = ["gid", "hctx", "obj", "cnt"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_tasks_of_a_streamed_sketch_pass_on_few_entries(spark):
    records = spark.createDataFrame([(g, i, genome(g * 100 + i, 5000)) for g in range(3) for i in range(8)], "gid long, record_ord long, seq string").repartition(2)
    passed = sequences._partial(records.select("gid", "seq"), Pattern(), 100)
    assert passed.count() <= 2 * 3 * 101 < sequences.windows(records).count() / 100


def test_code_reaches_workers_that_do_not_have_it(tmp_path):
    """The package is on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "run.py").write_text(
        f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\nspark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\nq = e.queries()\nprint('ROWS', [q[n](spark, '/root/testdata/sf0.001').count() for n in ('identity_report', 'reads_qc_range', 'streamed_sketch')])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout and "0" not in done.stdout.split("ROWS")[1].strip("[] \n").split(", "), done.stderr[-2000:]
