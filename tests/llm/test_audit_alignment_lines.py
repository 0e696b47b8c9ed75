"""Filter audit, tokenizer alignment and line deduplication against plain versions and odd tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchlake.llm import alignment, line_dedup
from sketchlake.llm.alignment import align_tokenizers, load_side
from sketchlake.llm.filter_audit import audit, failures
from sketchlake.llm.line_dedup import drop_repeated_lines
from sketchlake.llm.queries import vocabulary
from sketchlake.llm.runtime import frequency_floor

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, row string, part string, digest string, name string, id long, bits int, a int, place long"
ODD = [None, "", "\n", " \n\t\n", "one", "One\n one \nONE\x0b", "x " * 3000, "émile  É\x1c\x0b", "<|endoftext|> a <s> </s>", "同じ 文字\n同じ 文字", "a\x00b", "▁   x", "ﬁne ½ Å\r\n", "﻿q", "🙂🙂 \U0001f468‍\U0001f469 naïve"]


def corpus(seed=3, n=80):
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcdeéABC#") for _ in range(dice.randint(1, 5)))
    lines = [" ".join(word() for _ in range(dice.randint(1, 9))) for _ in range(12)]
    texts = list(ODD)
    for _ in range(n):
        own = [dice.choice(lines) if dice.random() < 0.4 else " ".join(word() for _ in range(dice.choice([1, 5, 30]))) for _ in range(dice.randint(1, 9))]
        own = [dice.choice([x, x.upper(), f"\t{x} "]) for x in own]
        texts += ["\n".join(own)] * dice.choice([1, 1, 1, 3])
    return texts


def frame(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, g, "r", "p", "d", "n", 7, 3, 5, 9) for i, t, g in zip(ids, texts, langs, strict=True)], DOCS)


# --- filter audit -----------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """Every order walked document by document."""
    good, toxic = ({i for i, *marks in labels if marks[k] == 1} for k in (0, 1))
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    docs = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = firsts.get(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": first is not None and (i is None or i > first),
        }
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shares = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in own)
                shares[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shares[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_a_walk_over_all_orders(spark):
    texts = corpus()
    dice = random.Random(1)
    langs = [dice.choice(["en", "de", None, "", "fr"]) for _ in texts]
    ids = [None if i % 17 == 3 else i - i % 2 if i % 13 == 0 else i for i in range(len(texts))]
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for i in range(0, len(texts), 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10**9, 1, 1)]
    docs = frame(spark, texts, ids, langs).repartition(5)
    got = audit(failures(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    want = brute_audit(list(zip(ids, texts, langs, strict=True)), [x for x in labels if x[0] is not None])
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want


def test_audit_of_no_rows_and_of_one_group_of_copies(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(failures(frame(spark, []), labels)).count() == 0
    rows = audit(failures(frame(spark, ["same text"] * 500).repartition(7), labels)).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [r.removed for r in rows] == [499, 1, 0, 0, 0] and rows[0].kept == 1 and len(rows) == 5
    # heavy groups go by broadcast, light ones by the join: both give the same
    flags = failures(frame(spark, ["same text"] * 50 + [f"t{i // 2}" for i in range(9000)]), labels)
    assert flags.where("E").count() == 49 + 4500


def test_audit_of_any_filters_and_labels(spark):
    rows = [("p", i % 2 == 0, i % 3 == 0, i % 5 == 0) for i in range(30)] + [("q", None, True, False)]
    got = audit(spark.createDataFrame(rows, "part string, X boolean, Y boolean, l boolean"), "XY", ["l"]).collect()
    at = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.l_lost, r.shapley) for r in got}
    assert at["p", "XY", 2] == (10, 5, 5, 5, 1, 15) and at["q", "XY", 1] == (1, 0, 0, 0, 0, 0) and len(at) == 8


# --- alignment --------------------------------------------------------------------------------------------------


def brute_alignment(texts, sides):
    """Tokens as byte ranges, compared pair by pair."""
    docs = []
    for t in texts:
        ids = [side.whole([t])[0] if t else [] for side in sides]
        whole = (" " + (t or "")).encode()
        if not t or any(b"".join(s.entries[x] for x in own) != whole for s, own in zip(sides, ids, strict=True)):
            ids = [[], []]
        spans = []
        for s, own in zip(sides, ids, strict=True):
            ends = list(itertools.accumulate(len(s.entries[x]) for x in own))
            spans.append(list(zip([0, *ends], ends, strict=False)))
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, last = [], 0
        for cut in shared:
            groups.append("|".join(",".join(str(x) for x, (lo, hi) in zip(own, where, strict=True) if last <= lo and hi <= cut) for own, where in zip(ids, spans, strict=True)))
            last = cut
        links = [(x, y) for x, (a, b) in zip(ids[0], spans[0], strict=True) for y, (c, d) in zip(ids[1], spans[1], strict=True) if max(a, c) < min(b, d)]
        docs.append((ids, groups, links))
    counts = collections.Counter(x for _, _, links in docs for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(len(i[0]), len(i[1]), len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), ";".join(g)) for i, g, k in docs]


@pytest.mark.parametrize("common", [1 << 20, 40, 1])
def test_alignment_equals_comparing_byte_ranges(spark, common, monkeypatch):
    monkeypatch.setattr(alignment, "GROUP_CHARACTERS", 400)
    monkeypatch.setattr(alignment, "GROUP_TOKENS", 100)
    monkeypatch.setattr(alignment, "FLUSH", 50)
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    texts = [t[:900] if t else t for t in corpus(n=25)]
    got = {r.row.doc_id: tuple(r)[1:] for r in align_tokenizers(frame(spark, texts).repartition(3), *paths, common_pairs=common).collect()}
    want = brute_alignment(texts, [load_side(p) for p in paths])
    assert got == dict(enumerate(want))
    assert sum(1 for t, w in zip(texts, want, strict=True) if t and not w[0]) and sum(w[3] > w[2] for w in want) > 20


def test_alignment_of_repeated_rows_and_no_rows(spark):
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    rows = align_tokenizers(frame(spark, ["some words"] * 3 + [None], [4, 4, None, None]), *paths, common_pairs=1).collect()
    assert sorted((r.row.doc_id or -1, r.n_a, r.count_sum) for r in rows) == [(-1, 0, 0), (-1, 2, 3 * 2), (4, 2, 3 * 2), (4, 2, 3 * 2)]
    assert rows[0].row.a == 5 and "text" not in rows[0].row.asDict()
    assert align_tokenizers(frame(spark, []), *paths).count() == 0


def test_chunks_have_the_ids_of_whole_texts():
    """Also around carriage returns, tabs, wide spaces and runs of white space, where pieces of the one or the other may lie across."""
    import pyarrow.parquet as pq

    sides = [load_side(vocabulary(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert all(s.chunk for s in sides)
    dice = random.Random(4)
    alphabet = ["a", "be", ");", "}", " ", "  ", "\n", "\r", "\r\n", "\t", "\x85", "\u3000", "\x1c", "é", "'s", "12", "▁", "<s>", "文", "\u200b", "e\u0301", "<|endoftext|>"]
    texts = ["".join(dice.choice(alphabet) for _ in range(dice.randint(1, 40))) for _ in range(3000)] + [t for t in corpus() if t]
    texts += [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if t]
    encoder = alignment._Encoder(sides)
    assert [[x.tolist() for x in side] for side in encoder.ids_of(texts)] == [[x.tolist() for x in side] for side in encoder._whole(texts)]


def test_ranks_and_places_of_bits():
    dice = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        at = np.unique(dice.integers(0, n, n // 2 + 1))
        words = alignment.bitset(at, n)
        assert alignment.select(words).tolist() == at.tolist()
        assert alignment.rank(words, np.arange(n + 1)).tolist() == [int((at < i).sum()) for i in range(n + 1)]


# --- lines ------------------------------------------------------------------------------------------------------


def brute_lines(rows, documents, characters=1, keep_first=False):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    keys = [[fold(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t in rows]
    count = collections.Counter(k for own in keys for k in set(own) if len(k) >= characters)
    first = {}
    for (i, _), own in zip(rows, keys, strict=True):
        for at, k in enumerate(own):
            first[k] = min(first.get(k, (True, 0, 0)), (i is not None, i or 0, at)) if k in first else (i is not None, i or 0, at)
    out = []
    for (i, t), own in zip(rows, keys, strict=True):
        gone = {at for at, k in enumerate(own) if count[k] >= documents and not (keep_first and first[k] == (i is not None, i or 0, at))}
        out.append((i, "\n".join(x for at, x in enumerate((t or "").split("\n")) if at not in gone), len(own), len(gone)))
    return collections.Counter(out)


@pytest.mark.parametrize("documents, characters, keep_first, common, bits", [(10, 1, False, 1 << 18, 1 << 29), (2, 1, False, 3, 1 << 29), (3, 4, True, 2, 1 << 12), (2, 1, True, 1 << 18, 1 << 29)])
def test_lines_equal_a_plain_count(spark, monkeypatch, documents, characters, keep_first, common, bits):
    monkeypatch.setattr(line_dedup, "FLUSH", 20)
    texts = corpus()
    ids = [None if i % 23 == 5 else i // 2 if i % 19 == 0 else i for i in range(len(texts))]
    docs = frame(spark, texts, ids).repartition(5)
    got = drop_repeated_lines(docs, documents, characters, keep_first, common, bits)
    assert collections.Counter((r.row.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(list(zip(ids, texts, strict=True)), documents, characters, keep_first)
    assert got.columns == ["row", "text", "n_lines", "n_dropped"]


def test_lines_of_no_rows_repeated_rows_and_long_texts(spark):
    assert drop_repeated_lines(frame(spark, [])).count() == 0
    rows = drop_repeated_lines(frame(spark, ["a\nb"] * 10 + ["b\nc", "\n".join(map(str, range(200_000))) + "\nA "], [1] * 10 + [2, None])).collect()
    assert sorted((r.row.doc_id or 0, r.n_lines, r.n_dropped) for r in rows) == [(0, 200_001, 1), *[(1, 2, 2)] * 10, (2, 2, 1)]


def test_filters_keep_most_single_lines_at_home(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {i} {j}" for j in range(50)) + ("\nshared" if i % 2 else "")) for i in range(200)], "doc_id long, text string").repartition(6)
    packed, bits = line_dedup.twice_filter(docs)
    probe = line_dedup._Probe(packed, bits, 1)
    assert probe.suspected([b"shared"]).tolist() == [0]
    single = [f"line {i} {j}".encode() for i in range(200) for j in range(50)]
    assert len(probe.suspected(single)) < 0.02 * len(single)
    found = line_dedup.repeated_lines(docs, packed, bits, 10).collect()
    assert [(bytes(r.digest), r.n, r.doc_id, r.line) for r in found] == [(hashlib.blake2b(b"shared", digest_size=16).digest(), 100, 1, 50)]


def test_frequency_floor_keeps_the_limit(spark):
    counts = spark.createDataFrame([(n,) for n in [1] * 50 + [2] * 20 + [3, 4, 7, 8, 9, 1 << 40]], "n long")
    for limit in (0, 1, 2, 3, 5, 6, 30, 100):
        floor = frequency_floor(counts, "n", limit)
        assert counts.where(F.col("n") >= floor).count() <= limit and (floor == 1) == (limit >= 76)
    assert frequency_floor(counts.where("n < 0"), "n", 5) == 1
