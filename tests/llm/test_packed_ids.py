"""Pieces with their ids: round trip, plan and repeated rows."""

import collections
import io
import zlib
from contextlib import redirect_stdout

import numpy as np

import corpus_pipeline
from sketchlake.llm import packing
from sketchlake.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_ids_return_to_their_places_and_only_narrow_rows_are_shuffled(spark):
    texts = ["some words here", None, "", "a b c " * 100, "some words here", "x"]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)] + [(None, "same"), (None, "same")], "doc_id long, text string").repartition(3)
    found = packing.pack(docs, PATH, capacity=50, id_bytes=True)
    rows = found.collect()
    plain = packing.pack(docs, PATH, capacity=50).collect()
    narrow = lambda r: (r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32)
    assert collections.Counter(map(narrow, rows)) == collections.Counter(map(narrow, plain))
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 50
    lists = packing.pack(docs, PATH, capacity=50, with_ids=True).collect()
    assert collections.Counter((narrow(r), tuple(r.ids)) for r in lists) == collections.Counter((narrow(r), tuple(np.frombuffer(bytes(r.ids), "<i4").tolist())) for r in rows)
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain()
    join = out.getvalue().split("ShuffledHashJoin")[1]
    side = join.split("MapInArrow")[0]  # of the two inputs the one with ids, up to the narrow rows
    assert "ids" in side and "Bucketed: true" in join
    assert packing.pack(docs.where("false"), PATH, id_bytes=True).count() == 0


def test_the_pipeline_gives_training_sequences(spark):
    rows = corpus_pipeline.pack_sequences(spark, spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string"), "").collect()
    assert {(r.doc_id, r.length) for r in rows} == {(1, 3), (2, 1)} and all(len(r.ids) == 4 * r.length for r in rows)
