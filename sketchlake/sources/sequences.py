"""Entries out of sequence records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchlake.functions.kmers import Pattern, WidePattern, context_entries
from sketchlake.operators import sketch as K
from sketchlake.session import checkpoint, ship

_ALL = np.uint64(2**64 - 1)
#: Entries that a task holds over all samples before it passes them on.
HELD_ENTRIES = 1 << 22


def _extract(pattern: Pattern | WidePattern, threshold: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, order, seq in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hctx, obj, at = context_entries(seq or "", pattern)
                if threshold is not None:
                    keep = hctx.view(np.uint64) <= np.uint64(threshold)
                    hctx, obj, at = hctx[keep], obj[keep], at[keep]
                for lo in range(0, len(hctx), 1 << 18):
                    part = slice(lo, lo + (1 << 18))
                    n = len(hctx[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gid, np.int64)), pa.array(np.full(n, order, np.int64)), pa.array(hctx[part]), pa.array(obj[part]), pa.array(at[part])], ["gid", "record_ord", "hctx", "obj", "pos"])

    return run


def windows(records: DataFrame, pattern: Pattern | WidePattern = Pattern(), threshold: int | None = None) -> DataFrame:
    """``gid, record_ord, hctx, obj, pos`` of every valid window of records ``gid, record_ord, seq``; a density threshold (an unsigned number) cuts within the kernel."""
    ship(records.sparkSession)
    named = records.select(F.col("gid").cast("long"), F.col("record_ord").cast("long"), "seq").dropna(subset=["gid", "record_ord"])
    return named.mapInArrow(_extract(pattern, threshold), "gid long, record_ord long, hctx long, obj int, pos long")


def entries(found: DataFrame) -> DataFrame:
    return found.groupBy("gid", "hctx", "obj").agg(F.count("*").alias("cnt"))


def split_records(records: DataFrame) -> DataFrame:
    """Each record its own sample, numbered by path and order (``record_ord`` counts a file's records from 0)."""
    from pyspark.sql import Window

    files = records.groupBy("path").agg((F.max("record_ord") + 1).alias("_n"))  # what meets in one task is a row per file
    files = files.select("path", (F.sum("_n").over(Window.orderBy("path")) - F.col("_n")).alias("_before"))
    return records.join(files, "path").withColumn("gid", (F.col("_before") + F.col("record_ord")).cast("long")).drop("_before")


def as_one(records: DataFrame) -> DataFrame:
    return records.withColumn("gid", F.lit(0).cast("long"))


# --- sketches while reading ------------------------------------------------------------------------------------------


@dataclass
class _Held:
    """What a task holds of a sample: its first distinct entries (hash, object) with their counts, complete up to and with ``limit``."""

    hctx: np.ndarray
    obj: np.ndarray
    cnt: np.ndarray
    limit: np.uint64 = _ALL

    def add(self, hctx: np.ndarray, obj: np.ndarray, keep: int) -> None:
        """Takes new windows in, in pieces, so that what is held stays within twice ``keep`` entries but for the objects of the last context."""
        for lo in range(0, len(hctx), 2 * keep):
            h, o = hctx[lo : lo + 2 * keep].view(np.uint64), obj[lo : lo + 2 * keep]
            inside = h <= self.limit
            h, o = np.concatenate((self.hctx, h[inside])), np.concatenate((self.obj, o[inside]))
            n = np.concatenate((self.cnt, np.ones(int(inside.sum()), np.int64)))
            order = np.lexsort((o, h))
            h, o, n = h[order], o[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))[: len(h)])
            h, o, n = h[first], o[first], np.add.reduceat(n, first) if len(first) else n[:0]
            if len(h) > keep:
                self.limit = h[keep - 1]
                end = int(np.searchsorted(h, self.limit, "right"))  # all objects of the last context stay
                h, o, n = h[:end], o[:end], n[:end]
            self.hctx, self.obj, self.cnt = h, o, n


def _prune(pattern: Pattern | WidePattern, keep: int, most: int):
    names = ["gid", "hctx", "obj", "cnt", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Held] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for gid, x in held.items():
                limit = np.full(len(x.hctx), x.limit).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.hctx), gid, np.int64)), pa.array(x.hctx.view(np.int64)), pa.array(x.obj), pa.array(x.cnt), pa.array(limit)], names)
            held.clear()

        for batch in batches:
            for gid, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hctx, obj, _ = context_entries(seq or "", pattern)
                if gid not in held:
                    if (len(held) + 1) * keep > most:
                        yield from flush()
                    held[gid] = _Held(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
                held[gid].add(hctx, obj, keep)
        yield from flush()

    return run


def _partial(records: DataFrame, pattern: Pattern | WidePattern, keep: int) -> DataFrame:
    return records.mapInArrow(_prune(pattern, keep, HELD_ENTRIES), "gid long, hctx long, obj int, cnt long, last long")


def streamed_sketch(records: DataFrame, k: int, pattern: Pattern | WidePattern = Pattern(), conflict: bool = False, slack: int = 2) -> DataFrame:
    """The sketch of size ``k`` of records ``gid, record_ord, seq``, as the full sort gives it, with at most ``slack * k`` entries a sample leaving a task.

    A task holds the first entries of each sample only: new windows beyond the last one held are passed over, and that limit falls as better ones come.
    Up to the lowest limit of a sample's tasks its entries and counts are complete. Conflicts may leave fewer than k of these, which isn't known before all
    tasks are merged; such samples are read again with four times the slack, until they have k or nothing of them was cut.
    """
    ship(records.sparkSession)
    todo, out = records.select(F.col("gid").cast("long").alias("gid"), "seq").dropna(subset=["gid"]), None
    while True:
        found = checkpoint(_partial(todo, pattern, slack * k))
        last = found.groupBy("gid").agg(F.min(K.unsigned("last")).alias("_last"))
        whole = found.join(last, "gid").where(K.unsigned("hctx") <= F.col("_last")).groupBy("gid", "hctx", "obj").agg(F.sum("cnt").alias("cnt"))
        built = K.wide_bottom_k if isinstance(pattern, WidePattern) else K.bottom_k
        sketch = checkpoint(built(whole if conflict else K.drop_conflicts(whole), k))
        size = F.count_distinct("hctx") if isinstance(pattern, WidePattern) else F.count("*")
        enough = sketch.groupBy("gid").agg(size.alias("_n")).where(F.col("_n") >= k).select("gid")
        short = checkpoint(last.where(F.col("_last") < F.lit(2**63 - 1)).select("gid").join(enough, "gid", "left_anti"))  # cut, and too few left
        done = sketch.join(short, "gid", "left_anti")
        out = done if out is None else out.union(done)
        if short.isEmpty():
            return out
        todo, slack = todo.join(short, "gid", "left_semi"), 4 * slack


def streamed_densities(records: DataFrame, k: int, pattern: WidePattern, slack: int = 2) -> DataFrame:
    """``wide_densities`` of records from entries pruned while reading, as ``streamed_sketch`` prunes them.

    A sample's entries are complete up to its lowest limit. Where something was cut, more than k contexts without conflict must lie below, so that the
    threshold does too; samples with fewer are read again with four times the slack.
    """
    ship(records.sparkSession)
    todo, out = records.select(F.col("gid").cast("long").alias("gid"), "seq").dropna(subset=["gid"]), None
    while True:
        found = checkpoint(_partial(todo, pattern, slack * k))
        last = found.groupBy("gid").agg(F.min(K.unsigned("last")).alias("_last"))
        whole = found.join(last, "gid").where(K.unsigned("hctx") <= F.col("_last")).groupBy("gid", "hctx", "obj").agg(F.sum("cnt").alias("cnt"))
        clean = K.drop_conflicts(whole).groupBy("gid").agg(F.count("*").alias("_n")).where(F.col("_n") > k).select("gid")
        short = checkpoint(last.where(F.col("_last") < F.lit(2**63 - 1)).select("gid").join(clean, "gid", "left_anti"))
        done = checkpoint(K.wide_densities(whole, k).join(short, "gid", "left_anti"))
        out = done if out is None else out.union(done)
        if short.isEmpty():
            return out
        todo, slack = todo.join(short, "gid", "left_semi"), 4 * slack
