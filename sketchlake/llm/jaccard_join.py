"""Exact n-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct k-word shingles, in one global order (the
order of their hashes). Say two sets of sizes nx and ny reach the similarity.
Then they share at least t tokens, at most dx = nx - t and dy = ny - t of either
are not shared, and the first M shared tokens lie within the first M + dx tokens
of one and M + dy of the other. With D = dx + dy and M = (run - 1)(D + 1) + rare,
these prefixes share either ``rare`` tokens of the rare class or (run - 1)(D + 1) + 1
of the frequent class; the latter are parted by at most D frequent tokens that
aren't shared, so ``run`` of them are neighbours among the frequent tokens of
both. Hence the index: single tokens for the rare class, of which a pair must
share ``rare``, and combinations of ``run`` neighbours for the frequent class.
Small sets, for which M would exceed t, treat all tokens as frequent and need no
rare ones; sizes near the limit are indexed both ways, so that any two partners
meet under one scheme. Where t is less than M even so (sizes 4 and 5 at 0.8), the at most D tokens
that aren't shared leave ceil(t / (D + 1)) shared ones side by side, and both sets
also send combinations of that length, of all their tokens.

Classes come from counts over all documents: saturating counters of two bits,
of a fixed number whatever the corpus, so that the broadcast is bounded by
2**(SKETCH_BITS - 2) bytes. A token is rare if its counter holds at most two.
Shared counters only make tokens frequent, which costs nothing but the rarer
single-token shortcut. No posting list is capped.

Candidates are connected into candidate groups (two documents that reach the
similarity always fall in one), each member's set is sent once to its group's
task, and intersections of all pairs of a block are counted as products of
membership matrices. A group too large for a task is cut into blocks by size
band and salt, and block pairs whose sizes can be partners go to separate tasks.

Equal sets are one node from the start, and every map task sends a combination
once whatever its number of documents, so exact copies cost their own rows only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchlake.llm import kernels as K
from sketchlake.llm.graph import components, local_roots
from sketchlake.llm.runtime import checkpoint, lean, release, ship

_U = np.uint64
SKETCH_BITS = 26
SLICES = 64
#: Rows of a candidate group's totals, at most.
SALTS = 32
FLUSH = 1_000_000
#: Text whose combinations share a bucket of the index; a bucket is one task's.
BUCKET_CHARACTERS = 4_000_000
#: Sets of up to SMALL tokens use combinations of all their tokens.
SMALL = 40


@dataclass(frozen=True)
class Join:
    """Shingle length, similarity num/den, length of a combination, shared rare tokens that make a candidate."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    run: int = 3
    rare: int = 3

    def partners(self, n: int) -> np.ndarray:
        """The sizes that a set of n tokens can reach the similarity with."""
        return np.arange(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def links(self, common, total):
        """Whether ``common`` of ``total`` tokens of both (with repeats) reach the similarity."""
        return self.den * common >= self.num * (total - common)


@lru_cache(maxsize=1 << 16)
def prefix_length(join: Join, n: int, rare: int) -> int:
    """How many leading tokens of a set of n meet those of every possible partner as the module's text says."""
    m = join.partners(n)
    t = -(-join.num * (n + m) // (join.den + join.num))
    dx, dy = n - t, m - t
    return int(min(n, (dx + (join.run - 1) * (dx + dy + 1) + rare).max()))


@lru_cache(maxsize=1 << 16)
def shorter_runs(join: Join, n: int) -> tuple[int, ...]:
    """Lengths of the combinations that a set of n tokens sends for partners with which it shares too few for the other schemes."""
    m = join.partners(n)
    t = -(-join.num * (n + m) // (join.den + join.num))
    parts = n + m - 2 * t + 1
    enough = (join.run - 1) * parts + np.where((n > SMALL) & (m > SMALL), join.rare, 1)
    lacking = (t < enough) & (t > 0) & (parts > 1)  # equal sets are one node
    return tuple(sorted({int(r) for r in np.minimum(-(-t // parts), join.run)[lacking]}))


def small_limit(join: Join) -> int:
    """Sizes up to this one are also indexed by the scheme for small sets."""
    return join.den * SMALL // join.num


# --- counting ---------------------------------------------------------------------------------------------------


def _sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    for group in K.groups(texts):
        found = K.words(group, K.FOLDED)
        for i in range(len(group)):
            yield group.first + i, K.shingle_set(found.hash[found.bounds[i] : found.bounds[i + 1]], shingle)


def _pack(counters: np.ndarray) -> bytes:
    four = counters.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8)
    return np.stack((packed & 3, packed >> 2 & 3, packed >> 4 & 3, packed >> 6), 1).ravel()


_COUNTED = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])


def _count_tokens(join: Join, bits: int, parts: int):
    per_slice = 1 << (bits - SLICES.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size, part = 0, 0

        def flush() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(kept), return_counts=True)
            n = np.minimum(n, 3).astype(np.uint8)
            rows = []
            edges = np.searchsorted(at, np.arange(SLICES + 1, dtype=np.int64) * per_slice)
            for s in range(SLICES):
                lo, hi = edges[s], edges[s + 1]
                if lo < hi:
                    step = np.diff(at[lo:hi] - s * per_slice, prepend=0)
                    wide = np.uint16 if step.max() < 1 << 16 else np.uint32
                    rows.append((s, part % parts, bytes([wide().itemsize]) + zlib.compress(len(step).to_bytes(8, "little") + step.astype(wide).tobytes() + n[lo:hi].tobytes(), 1)))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_COUNTED)], schema=_COUNTED)

        for batch in batches:
            for _, tokens in _sets(batch.column(0), join.shingle):
                if len(tokens) > SMALL:
                    kept.append((tokens >> _U(64 - bits)).astype(np.int64))
                    size += len(tokens)
                    part += len(tokens)
                if size > FLUSH:
                    yield flush()
                    kept, size = [], 0
        if size:
            yield flush()

    return run, per_slice


def _add_counts(per_slice: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(per_slice, np.uint8)
        for data in group["data"]:
            if data[0]:
                raw = zlib.decompress(data[1:])
                n = int.from_bytes(raw[:8], "little")
                at = np.cumsum(np.frombuffer(raw, f"u{data[0]}", n, 8), dtype=np.int64)
                total[at] = np.minimum(total[at] + np.frombuffer(raw, np.uint8, n, 8 + n * data[0]), 3)
            else:
                total = np.minimum(total + _unpack(data[1:]), 3)
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "part": [0], "data": [b"\0" + _pack(total)]})

    return run


def token_counters(docs: DataFrame, join: Join, characters: int) -> tuple[np.ndarray, int]:
    """Packed two-bit counters of all tokens of all texts, and the number of hash bits that index them."""
    bits = int(min(SKETCH_BITS, max(16, math.ceil(math.log2(max(characters, 1))))))
    parts = max(1, math.isqrt(docs.sparkSession.sparkContext.defaultParallelism + characters // 100_000_000))
    run, per_slice = _count_tokens(join, bits, parts)
    schema = "slice int, part int, data binary"
    counted = docs.select("text").mapInArrow(lean(run), schema)
    for keys in (["slice", "part"], ["slice"]):
        counted = counted.groupBy(*keys).applyInPandas(_add_counts(per_slice), schema)
    packed = np.zeros(1 << (bits - 2), np.uint8)
    for row in counted.collect():  # SLICES rows of a fixed size
        packed[row["slice"] * (per_slice // 4) : (row["slice"] + 1) * (per_slice // 4)] = np.frombuffer(row["data"], np.uint8, offset=1)
    return packed, bits


# --- index ------------------------------------------------------------------------------------------------------


def index_keys(join: Join, tokens: np.ndarray, is_rare) -> tuple[np.ndarray, np.ndarray]:
    """The combinations of a set's prefix, and its rare single tokens."""
    n, run = len(tokens), join.run
    keys, single = [], np.zeros(0, _U)

    def neighbours(of: np.ndarray) -> None:
        if len(of) >= run:
            keys.append(K.windows(of, run))

    if n <= small_limit(join):
        neighbours(tokens[: prefix_length(join, n, 1)])
    if n > SMALL:
        prefix = tokens[: prefix_length(join, n, join.rare)]
        rare = is_rare(prefix)
        neighbours(prefix[~rare])
        single = prefix[rare]
    for length in shorter_runs(join, n):
        keys.append(K.windows(tokens, length))
    return (np.concatenate(keys) if keys else np.zeros(0, _U)), single


_BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("size", pa.int32()), ("data", pa.binary())])


def _index(join: Join, counters, bits: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(counters.value, np.uint8)

        def is_rare(tokens: np.ndarray) -> np.ndarray:
            at = (tokens >> _U(64 - bits)).astype(np.int64)
            return (packed[at >> 2] >> ((at & 3) << 1).astype(np.uint8) & 3) < 3

        known: set[int] = set()
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind in (0, 1):
                if not held[kind]:
                    continue
                node = np.repeat(np.array([x[0] for x in held[kind]], np.int64), [len(x[1]) for x in held[kind]])
                key = np.concatenate([x[1] for x in held[kind]])
                order = np.argsort(key, kind="stable")
                key, node = key[order], node[order]
                if kind == 0:  # of the sets that share a combination here one speaks for all; the others are joined to it now
                    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    name, at = np.unique(node, return_inverse=True)
                    root = local_roots(np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key)))), at, len(name))
                    far = np.flatnonzero(root != np.arange(len(name)))
                    if len(far):
                        rows.append((len(known) % buckets, 3, len(far), name[far].tobytes() + name[root[far]].tobytes()))
                    key, node = key[begins], name[root[at[begins]]]
                home = (key >> _U(40)).astype(np.int64) * buckets >> 24
                edges = np.searchsorted(home, np.arange(buckets + 1))
                for b in range(buckets):
                    lo, hi = edges[b], edges[b + 1]
                    if lo < hi:
                        rows.append((b, kind, hi - lo, key[lo:hi].tobytes() + node[lo:hi].tobytes()))
            if held[2]:
                rows.append((len(known) % buckets, 2, len(held[2]), np.array(held[2], np.int64).tobytes()))
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOCK)], schema=_BLOCK)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, tokens in _sets(batch.column(1), join.shingle):
                a, b = K.set_name(tokens)
                held[2].append((int(ids[i]), len(tokens), a, b))
                size += 1
                if a not in known and len(tokens):
                    known.add(a)
                    keys, single = index_keys(join, tokens, is_rare)
                    for kind, found in ((0, np.unique(keys)), (1, single)):
                        if len(found):
                            held[kind].append((a, found))
                    size += len(keys) + len(single)
                if size > FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _merge_keys(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys with their nodes, each pair once, of the keys that several nodes have; and where each key begins."""
    key = np.concatenate([np.frombuffer(d, _U, n) for n, d in parts])
    node = np.concatenate([np.frombuffer(d, np.int64, n, 8 * n) for n, d in parts])
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    many = np.repeat(np.diff(np.append(begins, len(key))) > 1, np.diff(np.append(begins, len(key))))
    key, node = key[many], node[many]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    if len(key):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        key, node = key[new], node[new]
    return key, node, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


_FOUND = "kind byte, a long, b long, n int, m long"


def _candidates(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the documents' sizes and names (kind 2), edges of shared combinations (0), rare tokens shared by two nodes (1).

    A combination has one posting for each time that a map task sends, however many sets have it; edges found there come as they are (3).
    """
    out = [np.zeros((0, 5), np.int64)]
    of = {k: [(s, d) for s, d in zip(x["size"], x["data"], strict=True)] for k, x in group.groupby("kind")}
    if 2 in of:
        rows = np.concatenate([np.frombuffer(d, np.int64).reshape(-1, 4) for _, d in of[2]])
        out.append(np.stack((np.full(len(rows), 2), rows[:, 0], rows[:, 2], rows[:, 1], rows[:, 3]), 1))
    for n, data in of.get(3, ()):
        ends = np.frombuffer(data, np.int64).reshape(2, n)
        out.append(np.stack((np.zeros(n, np.int64), ends[0], ends[1], np.zeros(n, np.int64), np.zeros(n, np.int64)), 1))
    if 0 in of:
        _, node, begins = _merge_keys(of[0])
        if len(node):
            name, at = np.unique(node, return_inverse=True)
            root = local_roots(np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(node)))), at, len(name))
            far = np.flatnonzero(root != np.arange(len(name)))
            out.append(np.stack((np.zeros(len(far), np.int64), name[far], name[root[far]], np.zeros(len(far), np.int64), np.zeros(len(far), np.int64)), 1))
    if 1 in of:
        _, node, begins = _merge_keys(of[1])
        first = begins[np.diff(np.append(begins, len(node))) == 2]
        if len(first):
            pairs, n = np.unique(np.stack((node[first], node[first + 1]), 1), axis=0, return_counts=True)
            out.append(np.concatenate((np.ones((len(pairs), 1), np.int64), pairs, n[:, None], np.zeros((len(pairs), 1), np.int64)), 1))
    rows = np.concatenate(out)
    return pd.DataFrame({"kind": rows[:, 0].astype(np.int8), "a": rows[:, 1], "b": rows[:, 2], "n": rows[:, 3].astype(np.int32), "m": rows[:, 4]})


# --- verification -----------------------------------------------------------------------------------------------

BLOCK_SETS, BLOCK_TOKENS, COLUMNS = 1024, 1_500_000, 2048


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """The size of the intersection of every set of ``left`` with every one of ``right`` (or of ``left``)."""
    sets = left + (right or [])
    if right is None and len(left) == 2:
        n = len(np.intersect1d(left[0], left[1], assume_unique=True))
        return np.array([[len(left[0]), n], [n, len(left[1])]], np.int64)
    token = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    column = np.cumsum(np.concatenate(([False], token[1:] != token[:-1])))
    many = (np.bincount(column) > 1)[column]
    row = row[many]
    column = np.unique(column[many], return_inverse=True)[1]
    a = len(left)
    out = np.zeros((a, len(right) if right else a), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, (lo, lo + COLUMNS))
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[row[x:y], column[x:y] - lo] = 1
        out += (member[:a] @ (member[a:] if right else member).T).astype(np.int64)
    if right is None:
        np.fill_diagonal(out, [len(s) for s in left])
    return out


def _linked(join: Join, left: pd.DataFrame, right: pd.DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions in left (and right) of the pairs that link."""
    sets = [[np.frombuffer(t, _U) for t in side["tokens"]] for side in (left, right) if side is not None]
    common = _common(sets[0], sets[1] if right is not None else None)
    a, b = np.array([len(s) for s in sets[0]]), np.array([len(s) for s in sets[-1]])
    ok = join.links(common, a[:, None] + b[None, :])
    return np.nonzero(np.triu(ok, 1) if right is None else ok)


_LINKS = "u long, v long, weight long"


def _verify(join: Join):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows: list[np.ndarray] = []
        for _, part in group.groupby("part", sort=False):
            part = part.drop_duplicates("rep").reset_index(drop=True)  # rows of one id and text come once for each
            sides = [part[part["side"] == s].reset_index(drop=True) for s in (0, 1)]
            if not len(sides[0]) or (part["two"].iloc[0] and not len(sides[1])) or len(part) < 2:
                continue
            right = sides[1] if part["two"].iloc[0] else None
            i, j = _linked(join, sides[0], right)
            if not len(i):
                continue
            names = part["rep"].to_numpy() if right is None else np.concatenate((sides[0]["rep"], sides[1]["rep"]))
            copies = part["copies"].to_numpy() if right is None else np.concatenate((sides[0]["copies"], sides[1]["copies"]))
            j = j if right is None else j + len(sides[0])
            order = np.argsort(names)
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            root = names[order][local_roots(np.concatenate((np.arange(len(i)), np.arange(len(i)))), np.concatenate((rank[i], rank[j])), len(names))][rank]
            weight = np.bincount(i, copies[j], len(names)) + np.bincount(j, copies[i], len(names))
            hit = weight > 0
            rows.append(np.stack((names[hit], root[hit], weight[hit].astype(np.int64)), 1))
        found = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1], "weight": found[:, 2]})

    return run


_TASK = pa.schema([("task", pa.int64()), ("part", pa.string()), ("side", pa.int32()), ("two", pa.bool_()), ("rep", pa.int64()), ("copies", pa.int64()), ("tokens", pa.binary())])


def _send(join: Join):
    """Rows (text, rep, copies, sends) to one row of the token set for each task that the document goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, copies, sends = (batch.column(i).to_pylist() for i in (1, 2, 3))
            rows, size = [], 0
            for i, tokens in _sets(batch.column(0), join.shingle):
                data = tokens.tobytes()
                for s in sends[i]:
                    rows.append((s["task"], s["part"], s["side"], s["two"], rep[i], copies[i], data))
                    size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_TASK)], schema=_TASK)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_TASK)], schema=_TASK)

    return run


def _assign(join: Join, members: DataFrame) -> DataFrame:
    """Members (rep, copies, n, comp) with the tasks that each is sent to.

    Totals of a group meet its members by (group, salt), of which a group has at most SALTS rows
    however large it is, so that a giant group is many keys and a small one costs no more than its size.
    """
    step = math.log(join.den / join.num)
    members = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS))).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + 1e-9))
    parts = checkpoint(members.groupBy("comp", "salt", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")))
    bands = parts.groupBy("comp", "band").agg(F.sum("sets").alias("sets"), F.sum("tokens").alias("tokens"))
    salts = F.ceil(F.greatest(F.col("sets") / F.lit(BLOCK_SETS), F.col("tokens") / F.lit(BLOCK_TOKENS)))
    # bands of a group: as many as sizes have powers of the similarity, a few dozen
    totals = bands.groupBy("comp").agg(F.sum("sets").alias("sets"), F.sum("tokens").alias("tokens"), F.map_from_entries(F.collect_list(F.struct("band", salts.alias("salts")))).alias("bands")).where("sets > 1")
    spread = parts.select("comp", "salt").distinct().join(totals, "comp")
    members = members.join(spread, ["comp", "salt"])
    fits = (F.col("sets") <= BLOCK_SETS) & (F.col("tokens") <= BLOCK_TOKENS)
    held = members.where(fits).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, held // BLOCK_TOKENS + 1)
    own = F.struct(F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("task"), F.col("comp").cast("string").alias("part"), F.lit(0).alias("side"), F.lit(False).alias("two"))
    band, salt = F.col("band"), F.pmod(F.xxhash64("rep"), F.element_at("bands", F.col("band")))

    def send(band2: Column, salt2: Column) -> Column:
        first = (band < band2) | ((band == band2) & (salt <= salt2))
        same = (band == band2) & (salt == salt2)
        part = F.concat_ws("/", "comp", *[F.when(first, a).otherwise(b) for a, b in ((band, band2), (salt, salt2), (band2, band), (salt2, salt))])
        return F.struct(F.xxhash64(part).bitwiseOR(F.lit(-(1 << 63))).alias("task"), part.alias("part"), F.when(first, 0).otherwise(1).alias("side"), (~same).alias("two"))

    others = F.filter(F.array(band - 1, band, band + 1), lambda b: F.map_contains_key("bands", b))
    near = F.flatten(F.transform(others, lambda b: F.transform(F.sequence(F.lit(0).cast("long"), F.element_at("bands", b) - 1), lambda s: send(b, s))))
    return members.select("rep", "copies", F.when(fits, F.array(own)).otherwise(near).alias("sends"))


def join_documents(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``.

    ``docs`` has an integer ``doc_id`` and ``text``; rows with one id and text are copies of each other,
    and where one id has different texts, its links are those of all of them. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. ``component_id`` is the
    smallest doc_id reachable by links; ``n_links`` counts the other documents
    that the document links with directly, copies included. A null or wordless
    text has an empty set and links with nothing: its own component, no links. A
    text of fewer words than a shingle has its whole word sequence as the only
    shingle. Ties and repeated texts are one class with the smallest doc_id. An
    empty table gives an empty result. Rows without a doc_id take no part and come
    out with nulls. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nameless = docs.where("doc_id is null").select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("n_shingles", "component_id", "n_links")])
    docs = docs.where("doc_id is not null")
    characters = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    packed, bits = token_counters(docs, join, characters)
    counters = spark.sparkContext.broadcast(packed.tobytes())
    buckets = int(min(1 << 24, max(8, characters // BUCKET_CHARACTERS)))
    release(spark)
    found = checkpoint(docs.mapInArrow(lean(_index(join, counters, bits, buckets)), "bucket int, kind byte, size int, data binary").groupBy("bucket").applyInPandas(_candidates, _FOUND))
    release(spark)

    named = found.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").alias("name"), "n", F.col("m").alias("name2"))
    classes = named.where("n > 0").groupBy("name", "name2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    pairs = found.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= join.rare)
    edges = found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("a", "b"))
    groups = components(edges)
    groups = groups.union(groups.select(F.col("label").alias("node"), "label").distinct())
    members = checkpoint(_assign(join, classes.join(groups, classes["name"] == groups["node"]).select("rep", "copies", "n", F.col("label").alias("comp"))))

    release(spark)

    sent = docs.join(members, docs["doc_id"] == members["rep"]).select("text", "rep", "copies", "sends").mapInArrow(lean(_send(join)), "task long, part string, side int, two boolean, rep long, copies long, tokens binary")
    links = checkpoint(sent.groupBy("task").applyInPandas(_verify(join), _LINKS))
    del sent
    release(spark)

    root = components(links.select("u", "v"))
    weight = links.groupBy(F.col("u").alias("rep")).agg(F.sum("weight").alias("weight"))
    classes = (
        classes.join(weight, "rep", "left")
        .join(root, F.col("rep") == F.col("node"), "left")
        .select("name", "name2", "n", F.coalesce("label", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"))
    )
    joined = named.join(classes, ["name", "name2", "n"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    return joined.unionByName(nameless)
