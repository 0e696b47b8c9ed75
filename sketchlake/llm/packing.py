"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

What a bin can hold depends on lengths alone, and there are at most ``capacity``
of them. So the corpus is reduced to a count per length; the plan is made over
these counts and says how often each filling of a bin is used; then every piece
takes its place in the plan by its rank among the pieces of its length. The plan
and the counts don't grow with the corpus.

A bin starts with the longest remaining length and is filled with the longest
that fits, again and again. Then its smallest document gives way to two unpacked
ones if two exist that fill the gap it leaves more tightly than it does, as
often as that helps. The filling is used as many times as the counts allow.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchlake.llm import kernels as K
from sketchlake.llm.runtime import checkpoint, lean, shared_folder, ship, shuffle_width
from sketchlake.llm.tokens import load

#: Words and ids that a process keeps; beyond, it begins anew.
KEPT_WORDS, KEPT_IDS = 3_000_000, 24_000_000
#: Words that go to the tokenizer in one call, whose result it holds with much beside the ids.
AT_ONCE = 8192
#: How a tokenizer must read texts for its words to be encoded apart; others get whole texts.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}
#: What the tokenizer takes as one pre-token.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Kinds of bytes of which the tokenizer begins anew at each change, given letters beyond ASCII only and no apostrophes.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 11, 12, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC2, 0xC3, 0xC4, 0xC5]] = True


def _some(bad: np.ndarray, group: K.Group) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(bad)))[group.offsets]) > 0


def needs_whole(group: K.Group) -> np.ndarray:
    """Which texts must be encoded whole.

    Those are texts with characters other than ASCII and U+00A1 to U+017F
    (white space that is seen differently, characters that normalisation may
    join with a neighbour, whose lower case depends on context or is longer), or with the beginning of a
    special string.
    """
    data = group.bytes
    bad = ~_PLAIN[data]
    a, b = data[:-1], data[1:]
    bad[1:] |= (a == 0xC2) & ((b <= 0xA0) | (b == 0xAD)) | (a == 0xC4) & (b == 0xB0) | (a == 0x3C) & (b == 0x7C)
    return _some(bad, group)


def can_part(group: K.Group) -> np.ndarray:
    """Which texts have no apostrophe (contractions) and no sign beyond ASCII, so that letters and other characters are always parted."""
    data = group.bytes
    bad = (data == 0x27) | (data == 0xC2)
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    return ~_some(bad, group)


class WordEncoder:
    """Ids as uint32.

    For a lower-casing tokenizer that never joins text across white space (``BY_WORDS``),
    white-space-separated words, in most texts parted further into letters and
    others, are encoded once per process and kept by their 64-bit hash; a text's
    ids are then gathered by array operations. New words of letters are encoded
    many at a time, as one text whose pre-tokens they are. Other tokenizers get every text whole.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        settings = json.loads(self.tokenizer.to_str()) if hasattr(self.tokenizer, "to_str") else {}
        special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in settings.get("added_tokens", []))
        self.by_words = bool(settings) and special and all(settings[k] == v for k, v in BY_WORDS.items())
        self.forget()

    def forget(self) -> None:
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)  # of slot i: ids[begin[i]:begin[i + 1]]
        self.ids = np.zeros(0, np.uint32)

    def _raw(self, parts: list[str]) -> list[bytes]:
        if not hasattr(self.tokenizer, "encode_batch_fast"):
            return [np.array(ids, "<u4").tobytes() for ids in self.tokenizer.encode(parts, out_type=int, add_bos=False, add_eos=False, num_threads=1)] if parts else []
        return [np.array(e.ids, "<u4").tobytes() for lo in range(0, len(parts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(parts[lo : lo + AT_ONCE], add_special_tokens=False)]

    def _letters(self, parts: list[str]) -> list[bytes]:
        if len(parts) > AT_ONCE:
            return [x for lo in range(0, len(parts), AT_ONCE) for x in self._letters(parts[lo : lo + AT_ONCE])]
        found = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        word = np.array(found.word_ids, np.int64)
        edges = np.flatnonzero(np.diff(word, prepend=-1, append=len(parts))) * 4
        if len(edges) != len(parts) + 1:
            raise ValueError("a word of letters is not one pre-token")
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Keeps the ids of new words, given with their sorted hashes."""
        lower = [w.lower() for w in words]
        simple = [bool(_LETTERS.fullmatch(w)) for w in lower]
        letters = list({w for w, s in zip(lower, simple, strict=True) if s})
        others = [w for w, s in zip(words, simple, strict=True) if not s]
        found = dict(zip(letters, self._letters(letters), strict=True)) if letters else {}
        raw = iter(self._raw(others))
        own = [found[w] if s else next(raw) for w, s in zip(lower, simple, strict=True)]
        ends = self.begin[-1] + np.cumsum([len(x) // 4 for x in own], dtype=np.int64)
        new = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(own))
        self.begin = np.concatenate((self.begin, ends))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(own), "<u4")))
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.slot = np.insert(self.hash, at, hashes), np.insert(self.slot, at, new)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null is empty."""
        if not self.by_words:
            return [np.frombuffer(raw, "<u4") for raw in self._raw([t or "" for t in texts.to_pylist()])]
        if len(self.hash) > KEPT_WORDS or len(self.ids) > KEPT_IDS:
            self.forget()
        parts = []
        for group in K.groups(texts):
            found = K.words(group, K.FOLDED, _KIND, can_part(group))
            parts.append((group, found, needs_whole(group), *np.unique(found.hash, return_index=True, return_inverse=True)))
        every = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.uint64)
        every, source = np.unique(every, return_index=True)
        at = np.searchsorted(self.hash, every)
        fresh = np.flatnonzero((at == len(self.hash)) | (self.hash[np.minimum(at, len(self.hash) - 1)] != every)) if len(self.hash) else np.arange(len(every))
        if len(fresh):
            begins = np.cumsum([0, *(len(p[3]) for p in parts)])
            strings = []
            for k in source[fresh].tolist():
                i = int(np.searchsorted(begins, k, "right")) - 1
                group, found, _, _, first, _ = parts[i]
                w = first[k - begins[i]]
                strings.append(group.bytes[found.start[w] : found.end[w]].tobytes().decode())
            self.learn(every[fresh], strings)
        out: list[np.ndarray] = []
        for group, found, whole, unique, _, inverse in parts:
            slot = self.slot[np.searchsorted(self.hash, unique)]
            n, begin = (self.begin[slot + 1] - self.begin[slot])[inverse], self.begin[slot][inverse]
            end = np.cumsum(n)
            ids = self.ids[np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - n), n)]
            edges = np.concatenate(([0], end))[found.bounds]
            own = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            if whole.any():
                at = np.flatnonzero(whole)
                for i, raw in zip(at, self._raw([group.bytes[group.offsets[i] : group.offsets[i + 1]].tobytes().decode() for i in at]), strict=True):
                    own[i] = np.frombuffer(raw, "<u4")
            out += own
        return out


_ENCODERS: dict[str, WordEncoder] = {}
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    schema = _PIECES if with_ids else pa.schema(list(_PIECES)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(path, WordEncoder(path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = []
                for doc_id, found in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids = found.tobytes() + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own)[: len(schema)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, as little-endian unsigned 32-bit numbers): every document's ids with ``end_id`` last, in pieces of up to ``capacity``."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_cut(path, capacity, end_id, with_ids)), _COLUMNS + (", ids binary" if with_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Fillings of a bin, as falling lengths, and how often each is used; together they use up the counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = np.arange(capacity + 1)
    plan = []

    def fitting() -> np.ndarray:
        """Of each room, the longest remaining length that fits it, or 0."""
        return np.maximum.accumulate(np.where(free > 0, sizes, 0))

    while left.any():
        free = left.copy()
        top = int(np.flatnonzero(free)[-1])
        filling, gap = [top], capacity - top
        free[top] -= 1
        longest = fitting()
        while gap and (best := int(longest[gap])):
            n = int(min(free[best], gap // best))
            filling += [best] * n
            gap -= best * n
            free[best] -= n
            longest = np.maximum.accumulate(np.where(free > 0, sizes, 0)) if not free[best] else longest
        while gap and len(filling) > 1:
            small = filling[-1]
            room = gap + small
            free[small] += 1
            longest = fitting()
            first = sizes[1 : room + 1][free[1 : room + 1] > 0]
            second = longest[np.minimum(room - first, first)]
            second = np.where((second == first) & (free[first] < 2), longest[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            at = int(total.argmax()) if len(total) else 0
            if not len(total) or total[at] <= small:
                free[small] -= 1
                break
            a, b = int(first[at]), int(second[at])
            free[a] -= 1
            free[b] -= 1
            filling = sorted([*filling[:-1], a, b], reverse=True)
            gap = room - a - b
        use = np.bincount(filling, minlength=capacity + 1)
        used = np.flatnonzero(use)
        times = int((left[used] // use[used]).min())
        left -= use * times
        plan.append((filling, times))
    return plan


@dataclass
class Places:
    """The plan by length and rank: segments of ranks, each with its first bin, its uses per bin and their offsets."""

    key: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    uses: np.ndarray
    at: np.ndarray
    offset: np.ndarray
    SHIFT = 44

    @classmethod
    def of(cls, plan: list[tuple[list[int], int]], capacity: int) -> Places:
        taken, base = [0] * (capacity + 1), 0
        rows, offsets = [], []
        for filling, times in plan:
            place: dict[int, list[int]] = {}
            at = 0
            for length in filling:
                place.setdefault(length, []).append(at)
                at += length
            for length, where in place.items():
                rows.append((length << cls.SHIFT | taken[length], taken[length], base, len(where), len(offsets)))
                offsets += where
                taken[length] += times * len(where)
            base += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        return cls(*table, np.array(offsets, np.int64))

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length << self.SHIFT | rank, "right") - 1
        n = rank - self.rank[i]
        return self.bin[i] + n // self.uses[i], self.offset[self.at[i] + n % self.uses[i]]


def _place(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = places.value.look_up(length, rank)
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of ids as lists, a few rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            lists = [np.frombuffer(x, "<i4") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())) if n == "ids" else part.column(n) for n in batch.schema.names], batch.schema.names)


def _bucketed(pieces: DataFrame, buckets: int) -> DataFrame:
    """Pieces with a number of their own, ``place``, in a table of the shared folder, bucketed by it: each task deals its rows to the buckets' files, nothing is shuffled."""
    spark = pieces.sparkSession
    name = f"pieces_{uuid.uuid4().hex}"
    numbered = pieces.withColumn("place", F.monotonically_increasing_id())
    numbered.write.bucketBy(buckets, "place").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_bytes: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; ``with_ids`` adds the piece's ``ids``, ``id_bytes`` those as little-endian unsigned 32-bit numbers.

    Only documents longer than ``capacity`` are cut, into full pieces and a
    rest. A null or empty text is its end id alone. Equal texts and repeated
    rows are packed each; ties of length go by a hash of the id. An empty table
    gives no rows. Other columns are ignored. Ranks within a length are counted
    over hashed sub-ranges, so that one length, however common, is spread over
    many tasks. Ids stay in the bucketed table they are written to; what is ranked and shuffled are narrow rows, which meet their ids
    at the end, by buckets.
    """
    spark = docs.sparkSession
    held = with_ids or id_bytes
    pieces = cut_documents(docs, path, capacity, end_id, held)
    stored = _bucketed(pieces, max(shuffle_width(spark), spark.sparkContext.defaultParallelism)) if held else None
    pieces = stored.drop("ids") if held else checkpoint(pieces)
    own = pieces.columns
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row per length
    places = spark.sparkContext.broadcast(Places.of(plan_bins(counts, capacity), capacity))
    parts = max(shuffle_width(spark), sum(counts.values()) // 100_000)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("within", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", *(["place"] if held else []))) - 1).join(before, ["length", "part"])
    ranked = ranked.select(*own, (F.col("before") + F.col("within")).alias("rank"))
    placed = ranked.mapInArrow(_place(places), _COLUMNS + (", place long" if held else "") + ", sequence_id long, offset long")
    if not held:
        return placed
    # the narrow side is hashed in each bucket, so that rows with ids are neither shuffled nor sorted
    whole = stored.select("place", "ids").join(placed.hint("shuffle_hash"), "place").select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
    return whole if id_bytes else whole.mapInArrow(lean(_unpacked), _COLUMNS + ", ids array<int>, sequence_id long, offset long")
