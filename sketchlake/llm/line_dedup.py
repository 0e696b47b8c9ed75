r"""Lines that many documents repeat, found with two Bloom filters.

A line's key is the line with white space ``[\x20\x09-\x0D]`` stripped at both ends and A-Z lower-cased.

1. Every task sets the bits of its documents' keys in a filter ``once``, and those of keys that two of its documents have in a
   filter ``twice``. Merged, two tasks' filters give once = a | b and twice = ta | tb | (a & b): bits of a key that
   both have are in the intersection. So ``twice`` holds every key of two documents or more, and few others.
   Tasks send their set bits only, by slices of the filter; slices merge apart.
2. Only lines whose key ``twice`` holds are suspected. Their keys' 128-bit digests, counted within each task first, are all that
   shuffles; the sums confirm exactly in how many documents a key is, and choose its first occurrence.
3. Documents drop their lines by the confirmed keys. The COMMON most frequent ones reach the tasks by broadcast, rarer ones
   by a join of suspected lines with them; none of these is in more than a COMMON-th of all lines, so no join key is hot.

A filter has BITS_PER_LINE bits per line of the table, at most ``max_bits``. Beyond that (33 million lines by default) it tells fewer lines
apart and more of them shuffle in step 2; the result is the same.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchlake.llm import kernels as K
from sketchlake.llm.runtime import checkpoint, frequency_floor, lean, ship

_U = np.uint64
BITS_PER_LINE, HASHES, SLICES = 16, 4, 64
#: Distinct keys that a task holds before it sends them on.
FLUSH = 500_000
#: Confirmed keys that are broadcast, at most (with their first occurrences about 250 bytes each in a worker).
COMMON = 1 << 18
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def line_keys(data: bytes) -> list[bytes]:
    return [line.strip(WHITE) for line in data.translate(_LOWER).split(b"\n")]


def _texts(column: pa.Array) -> Iterator[bytes]:
    for group in K.groups(column):
        data = group.bytes.tobytes()
        for a, b in zip(group.offsets, group.offsets[1:], strict=False):
            yield data[a:b]


def _long_enough(key: bytes, characters: int) -> bool:
    return len(key) >= characters and (characters <= 1 or len(key.decode("utf-8", "replace")) >= characters)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each 64-bit hash, a row per hash."""
    step = (hashes >> _U(32)) | _U(1)
    return ((hashes[:, None] + np.arange(HASHES, dtype=_U) * step[:, None]) & _U(bits - 1)).astype(np.int64)


# --- filters ----------------------------------------------------------------------------------------------------

_SLICE = "slice int, part int, once binary, twice binary"


def _sparse(at: np.ndarray) -> bytes:
    return zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes(), 1)


def _dense(plane: np.ndarray) -> bytes:
    return b"\1" + zlib.compress(np.packbits(plane).tobytes(), 1)


def _plane(data: bytes, n: int) -> np.ndarray:
    if data[:1] == b"\1":
        return np.unpackbits(np.frombuffer(zlib.decompress(data[1:]), np.uint8), count=n).astype(bool)
    plane = np.zeros(n, bool)
    plane[np.cumsum(np.frombuffer(zlib.decompress(data[1:]), np.uint32), dtype=np.int64)] = True
    return plane


def _local_filters(bits: int, parts: int, characters: int, most: int):
    n = bits // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        sent = 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(seen.keys(), _U, len(seen))
            again = np.fromiter(seen.values(), np.int64, len(seen)) > 1
            once, twice = (np.unique(positions(h, bits)) for h in (hashes, hashes[again]))
            rows = []
            for s in range(SLICES):
                own = [at[np.searchsorted(at, s * n) : np.searchsorted(at, (s + 1) * n)] - s * n for at in (once, twice)]
                if len(own[0]):
                    rows.append((s, sent % parts, *[b"\0" + _sparse(at) for at in own]))
            seen.clear()
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["slice", "part", "once", "twice"])

        for batch in batches:
            for data in _texts(batch.column(0)):
                for key in set(line_keys(data)):
                    if _long_enough(key, characters):
                        code = xxhash.xxh3_64_intdigest(key)
                        seen[code] = seen.get(code, 0) + 1
                        sent += code & 0xFF
                if len(seen) > most:
                    yield flush()
        if seen:
            yield flush()

    return run


def _merge(n: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(n, bool), np.zeros(n, bool)
        for a, b in zip(group["once"], group["twice"], strict=True):
            more = _plane(a, n)
            twice |= _plane(b, n) | (once & more)
            once |= more
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "part": [0], "once": [_dense(once)], "twice": [_dense(twice)]})

    return run


def twice_filter(docs: DataFrame, characters: int = 1, max_bits: int = 1 << 29) -> tuple[bytes, int]:
    """The packed filter of keys that two documents or more have (and of few others), and its number of bits, at most ``max_bits``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.agg(F.sum(1 + F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))))).first()[0] or 1
    bits = int(min(max_bits, 1 << max(12, math.ceil(math.log2(BITS_PER_LINE * lines)))))
    parts = max(1, math.isqrt(docs.sparkSession.sparkContext.defaultParallelism + lines // FLUSH))
    found = docs.select(text.alias("text")).mapInArrow(lean(_local_filters(bits, parts, characters, FLUSH)), _SLICE)
    for keys in (["slice", "part"], ["slice"]):
        found = found.groupBy(*keys).applyInPandas(_merge(bits // SLICES), _SLICE)
    packed = np.zeros(bits // 8, np.uint8)
    width = bits // SLICES // 8
    for row in found.select("slice", "twice").collect():  # SLICES rows of a fixed size
        packed[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(row["twice"])[1:]), np.uint8)
    return packed.tobytes(), bits


class _Probe:
    """Which keys the filter holds."""

    def __init__(self, packed: bytes, bits: int, characters: int):
        self.packed, self.bits, self.characters = np.frombuffer(packed, np.uint8), bits, characters

    def suspected(self, keys: list[bytes]) -> np.ndarray:
        at = positions(np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), _U, len(keys)), self.bits)
        held = (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(1)
        return np.flatnonzero(held & np.fromiter((_long_enough(k, self.characters) for k in keys), bool, len(keys)))


# --- confirmation -----------------------------------------------------------------------------------------------

_FOUND = "digest binary, n long, doc_id long, line int"


def _count_suspected(packed, bits: int, characters: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(packed.value, bits, characters)
        held: dict[bytes, tuple] = {}

        def flush() -> pa.RecordBatch:
            columns = [list(held), *[[v[i] for v in held.values()] for i in range(3)]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["digest", "n", "doc_id", "line"])

        first = lambda v: (v[1] is not None, v[1] or 0, v[2])
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                keys = line_keys(data)
                mine: dict[bytes, int] = {}
                for i in probe.suspected(keys):
                    mine.setdefault(_digest(keys[i]), int(i))
                for digest, i in mine.items():
                    new, old = (1, doc_id, i), held.get(digest)
                    held[digest] = new if old is None else (old[0] + 1, *min(old, new, key=first)[1:])
                if len(held) > most:
                    yield flush()
        if held:
            yield flush()

    return run


def repeated_lines(docs: DataFrame, packed: bytes, bits: int, documents: int = 10, characters: int = 1) -> DataFrame:
    """``digest, n, doc_id, line``: keys that at least ``documents`` rows have, with their first occurrence (by id, nulls first, then line from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(lean(_count_suspected(shared, bits, characters, FLUSH)), _FOUND)
    found = found.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "line")).alias("first")).where(F.col("n") >= documents)
    return found.select("digest", "n", "first.doc_id", "first.line")


# --- dropping ---------------------------------------------------------------------------------------------------


def _rare_suspects(packed, common, bits: int, characters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, known = _Probe(packed.value, bits, characters), common.value
        for batch in batches:
            name, rows, digests = batch.column(0), [], []
            for i, data in enumerate(_texts(batch.column(1))):
                keys = line_keys(data)
                own = {_digest(keys[j]) for j in probe.suspected(keys)}
                own = [d for d in own if d not in known]
                rows += [i] * len(own)
                digests += own
            yield pa.RecordBatch.from_arrays([name.take(pa.array(rows, pa.int64())), pa.array(digests, pa.binary())], ["name", "digest"])

    return run


def _drop(packed, common, bits: int, characters: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, known = _Probe(packed.value, bits, characters), common.value
        for batch in batches:
            texts, lines, dropped = [], [], []
            for doc_id, rare, data in zip(batch.column("id").to_pylist(), batch.column("rare").to_pylist(), _texts(batch.column("text")), strict=True):
                keys = line_keys(data)
                own = {r["digest"]: (r["doc_id"], r["line"]) for r in rare or ()}
                gone = set()
                for i in probe.suspected(keys):
                    digest = _digest(keys[i])
                    first = known.get(digest) or own.get(digest)
                    if first is not None and not (keep_first and first == (doc_id, i)):
                        gone.add(int(i))
                lines.append(len(keys))
                dropped.append(len(gone))
                texts.append(b"\n".join(x for i, x in enumerate(data.split(b"\n")) if i not in gone) if gone else data)
            arrays = [batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "n_lines", "n_dropped"])

    return run


def drop_repeated_lines(docs: DataFrame, documents: int = 10, characters: int = 1, keep_first: bool = False, common_keys: int = COMMON, max_bits: int = 1 << 29) -> DataFrame:
    """``row`` (the document's other columns), ``text`` without repeated lines, ``n_lines`` (before), ``n_dropped``.

    A key of at least ``characters`` code points that at least ``documents`` documents (2 or more) have loses all its lines in every document; with
    ``keep_first`` the first line of it stays, that of the smallest id (a null id is the smallest; rows of one id with the line in one place all
    keep it). Other lines stay as they are, joined by \\n. Rows count as documents each, repeated ones too. A null
    or empty text is one empty line, which has no key. An empty table gives no rows.
    """
    if documents < 2:
        raise ValueError("a repeated line is in two documents or more")
    spark = docs.sparkSession
    ship(spark)
    packed, bits = twice_filter(docs, characters, max_bits)
    shared = spark.sparkContext.broadcast(packed)
    repeated = checkpoint(repeated_lines(docs, packed, bits, documents, characters))
    floor = frequency_floor(repeated, "n", common_keys)
    common = spark.sparkContext.broadcast({bytes(r["digest"]): (r["doc_id"], r["line"]) for r in repeated.where(F.col("n") >= floor).collect()})  # common_keys at most
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(0).alias("none")).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    if floor > documents:  # there are rarer keys
        # the keys of a text depend on the text alone, so rows of one id and text may share a name
        rows = rows.withColumn("name", F.struct("id", F.sha2("text", 256).alias("sha")))
        rare = rows.select("name", "text").mapInArrow(lean(_rare_suspects(shared, common, bits, characters)), T.StructType().add("name", rows.schema["name"].dataType).add("digest", "binary"))
        rare = rare.distinct().join(repeated.where(F.col("n") < floor).select("digest", "doc_id", "line"), "digest")
        rare = rare.groupBy("name").agg(F.collect_list(F.struct("digest", "doc_id", "line")).alias("rare"))  # a document's own lines
        rows = rows.alias("a").join(rare.alias("b"), F.col("a.name").eqNullSafe(F.col("b.name")), "left").select("a.row", "a.id", "a.text", "b.rare")
    else:
        rows = rows.withColumn("rare", F.lit(None).cast("array<struct<digest:binary,doc_id:bigint,line:int>>"))
    schema = T.StructType().add("row", rows.schema["row"].dataType).add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    return rows.mapInArrow(lean(_drop(shared, common, bits, characters, keep_first)), schema)
