"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's windows are its runs of ``window`` consecutive words (a shorter item is
one window). A window is held as a sequence of shingles of up to ``shingle``
words. Shingles are ordered by rarity: how often each shingle of the benchmark
occurs in all documents. Containment must be whole, so the necessary prefix of a
window is its one rarest shingle: a document that has the window has that
shingle. Documents are joined with windows on it; a match at word p of a
document and offset o of the window puts the window at p - o, which must not lie
before the text (positional bound) nor reach beyond it (length bound); then all
words are compared.

Documents are never shuffled. The benchmark goes to the tasks in blocks of items
with at most about BLOCK_WORDS words, whatever its size; with several blocks the
documents pass through them one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchlake.llm import kernels as K
from sketchlake.llm.runtime import checkpoint, lean, ship

_U = np.uint64
BLOCK_WORDS = 2_000_000
CHUNK = 1 << 16


class Windows:
    """The distinct windows of a block of items, by length, with the items of each."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, shingle: int):
        self.names = np.array([name for name, _ in items], object)
        self.shingle = shingle
        by_length: dict[int, tuple[list, list]] = {}
        for i, (_, codes) in enumerate(items):
            length = min(window, len(codes))
            if length:
                rows = np.lib.stride_tricks.sliding_window_view(codes, length)
                held = by_length.setdefault(length, ([], []))
                held[0].append(rows)
                held[1].append(np.full(len(rows), i, np.int64))
        #: length: (words of each window, where its items begin, items)
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, (rows, owner) in sorted(by_length.items()):
            rows, at = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((at.ravel(), np.concatenate(owner)), 1), axis=0)
            self.of[length] = (rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1])

    def width(self, length: int) -> int:
        return min(self.shingle, length)

    def widths(self) -> list[int]:
        return sorted({self.width(n) for n in self.of})

    def shingles(self, length: int) -> np.ndarray:
        """The shingle hashes of each window of the length, in order."""
        rows, k = self.of[length][0], self.width(length)
        return np.stack([K.windows(rows[:, i : i + k].T, k)[0] for i in range(length - k + 1)], 1)

    def vocabulary(self) -> dict[int, np.ndarray]:
        """Width: the sorted distinct shingles."""
        out = {}
        for k in self.widths():
            out[k] = np.unique(np.concatenate([self.shingles(n).ravel() for n in self.of if self.width(n) == k]))
        return out


class Prefixes:
    """For each length, windows and offsets of their rarest shingles, sorted by that shingle."""

    def __init__(self, windows: Windows, counts: dict[int, np.ndarray]):
        vocabulary = windows.vocabulary()
        self.of = {}
        for length in windows.of:
            codes, k = windows.shingles(length), windows.width(length)
            rank = np.empty(len(vocabulary[k]), np.int64)
            rank[np.lexsort((vocabulary[k], counts[k]))] = np.arange(len(rank))
            offset = rank[np.searchsorted(vocabulary[k], codes)].argmin(1)
            prefix = codes[np.arange(len(codes)), offset]
            order = np.argsort(prefix, kind="stable")
            key, begins = np.unique(prefix[order], return_index=True)
            self.of[length] = (k, key, np.append(begins, len(order)), order, offset[order])


def _look_up(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in codes that hold a key, and which."""
    at = np.searchsorted(keys, codes)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == codes)
    return hit, at[hit]


def _count(windows_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = windows_of.value.vocabulary()
        total = {k: np.zeros(len(v), np.int64) for k, v in vocabulary.items()}
        for batch in batches:
            for group in K.groups(batch.column(0)):
                found = K.words(group, K.ALNUM)
                last = np.repeat(found.bounds[1:], np.diff(found.bounds))
                for k, keys in vocabulary.items():
                    codes = K.windows(found.hash, k)
                    hit, at = _look_up(keys, codes)
                    total[k] += np.bincount(at[hit + k <= last[hit]], minlength=len(keys))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])], ["width", "at", "n"])

    return run


def _scan(windows_of, prefixes_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefixes = windows_of.value, prefixes_of.value
        for batch in batches:
            texts = batch.column("row").field("text")
            spans, items, n_words = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), []
            for group in K.groups(texts):
                found = K.words(group, K.ALNUM)
                n_words.append(np.diff(found.bounds))
                last = np.repeat(found.bounds[1:], np.diff(found.bounds))
                begin = np.repeat(found.bounds[:-1], np.diff(found.bounds))
                owner = np.repeat(np.arange(len(group)), np.diff(found.bounds))
                cover = np.zeros(len(found.hash) + 1, np.int64)
                hits: list[np.ndarray] = []
                shingles = {k: K.windows(found.hash, k) for k in windows.widths()}
                for length, (k, keys, bounds, window, offset) in prefixes.of.items():
                    rows, item_bounds, owners = windows.of[length]
                    position, at = _look_up(keys, shingles[k])
                    for lo in range(0, len(position), CHUNK):
                        p, a = position[lo : lo + CHUNK], at[lo : lo + CHUNK]
                        n = bounds[a + 1] - bounds[a]
                        w = np.repeat(bounds[a], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        p = np.repeat(p, n)
                        start, w = p - offset[w], window[w]
                        ok = (start >= begin[p]) & (start + length <= last[p])
                        start, w = start[ok], w[ok]
                        same = np.ones(len(start), bool)
                        for i in range(length):
                            same &= found.hash[start + i] == rows[w, i]
                        start, w = start[same], w[same]
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + length, -1)
                        n = item_bounds[w + 1] - item_bounds[w]
                        item = owners[np.repeat(item_bounds[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                        hits.append(np.unique(np.stack((np.repeat(owner[start], n), item), 1), axis=0))
                hit = np.unique(np.concatenate(hits), axis=0) if hits else np.zeros((0, 2), np.int64)
                covered = np.cumsum(cover[:-1]) > 0
                for d in np.unique(hit[:, 0]):
                    words = covered[found.bounds[d] : found.bounds[d + 1]].astype(np.int8)
                    edges = np.flatnonzero(np.diff(words, prepend=0, append=0))
                    spans[group.first + d] = (spans[group.first + d] or []) + edges.tolist()
                    items[group.first + d] = sorted({*(items[group.first + d] or []), *windows.names[hit[hit[:, 0] == d, 1]]})
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"_spans": pa.array(spans, pa.list_(pa.int32())), "_items": pa.array(items, pa.list_(pa.string()))}
            columns["_n_words"] = pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _finish(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, digest = batch.column("_n_words").to_pylist(), [], []
            for spans in batch.column("_spans").to_pylist():
                edges = sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else []
                total, reach = 0, 0
                for a, b in edges:
                    total += max(0, b - max(a, reach))
                    reach = max(reach, b)
                n_hit.append(total)
            items = [x or [] for x in batch.column("_items").to_pylist()]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            flag = [h > 0 and den * h >= num * n for h, n in zip(n_hit, n_words, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("_n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(digest, pa.string()), pa.array(flag, pa.bool_())],
                ["row", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"],
            )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, num: int = 1, den: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``row`` (the document's own columns, whatever their names), ``n_words, n_hit, n_items, items, items_sha256, contaminated``.

    ``docs`` has a ``text``, ``benchmark`` ``item_id`` and ``text``. Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A document's word
    is hit if it lies in an occurrence of any window; ``items`` are the ids, as
    sorted strings, of the items with an occurring window; a document is
    contaminated if hit at all and ``den * n_hit >= num * n_words``. A null text
    has no words and is clean; an item without words or with a null id has no windows or
    counts by the id "null". Items with equal texts all count. Repeated rows are
    judged each. Empty documents or an empty benchmark give clean or no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // (5 * block_words)))
    schema = T.StructType().add("row", docs.schema).add("_spans", T.ArrayType(T.IntegerType())).add("_items", T.ArrayType(T.StringType())).add("_n_words", "long")
    frame = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.lit(None).cast("array<int>").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"), F.lit(0).cast("long").alias("_n_words"))
    for block in range(blocks):
        held = []
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").toLocalIterator():  # about block_words words
            for group in K.groups(pa.array([row["text"]], pa.large_string())):
                held.append((row["item_id"], K.words(group, K.ALNUM).hash))
        windows = Windows(held, window, shingle)
        shared = spark.sparkContext.broadcast(windows)
        counts = {k: np.zeros(len(v), np.int64) for k, v in windows.vocabulary().items()}
        if windows.of:
            counted = docs.select(F.col("text").cast("string")).mapInArrow(lean(_count(shared)), "width int, at long, n long").groupBy("width", "at").agg(F.sum("n").alias("n"))
            for row in counted.toLocalIterator():  # no more rows than the block has shingles
                counts[row["width"]][row["at"]] = row["n"]
        prefixes = spark.sparkContext.broadcast(Prefixes(windows, counts))
        frame = frame.mapInArrow(lean(_scan(shared, prefixes)), schema)
        if blocks > 1:
            frame = checkpoint(frame)
    out = T.StructType().add("row", docs.schema).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items", T.ArrayType(T.StringType())).add("items_sha256", "string").add("contaminated", "boolean")
    return frame.mapInArrow(_finish(num, den), out)
