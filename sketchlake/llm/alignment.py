"""Alignment of two tokenizers' tokens over the same bytes, by packed bitsets.

Both tokenizers' tokens cut a text's bytes. A bitset per tokenizer marks the bytes at which its tokens end; many texts
lie in one pair of bitsets, as the end of a text is an end in both. Their AND marks the shared cuts, which divide
the tokens into groups; ranks by popcount say how many tokens of either side end before a cut, that is the groups' token ranges. Their OR
marks the ends of all overlaps of two tokens: as an overlap is one run of bytes, every bit of it is one link, and the ranks at the bit name its
two tokens.

Texts are encoded once, in chunks cut where neither tokenizer ever has a token across and whose ids are remembered (texts go whole
for tokenizers that don't allow it); ids are written to the shared folder. Links are counted by pair of ids
within each task, then summed. For the documents' own sums the most frequent pairs, at most COMMON, are
broadcast with their counts; links of rarer pairs meet their counts in a join, where no pair is in more than a
COMMON-th of all links.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchlake.llm.runtime import checkpoint, frequency_floor, lean, ship, store

_U = np.uint64
#: Characters that are encoded together, and A tokens that are aligned together; a longer text goes alone.
GROUP_CHARACTERS, GROUP_TOKENS = 1 << 18, 1 << 17
#: Pairs of ids that are broadcast, at most (17 bytes each), and distinct pairs that a task holds before it sends them on.
COMMON, FLUSH = 1 << 21, 1 << 20


# --- tokenizers -------------------------------------------------------------------------------------------------


#: Text from a space or line feed after another character up to the next such place; white space of other kinds doesn't part it.
CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Characters of chunks whose ids a task remembers, at most.
REMEMBERED = 1 << 22


@dataclass(frozen=True)
class Side:
    """A tokenizer with the bytes of its entries by id. ``whole`` encodes texts with a space before; ``chunk`` encodes chunks, and is None unless that gives the same ids."""

    whole: Callable[[list[str]], list[list[int]]]
    chunk: Callable[[list[str]], list[list[int]]] | None
    entries: tuple[bytes, ...]


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_side(path: str) -> Side:
    """sentencepiece adds the space. Pieces are merged by score alone, so no merge crosses a place that is inside no piece: chunks may
    go alone if no piece holds a space or line feed after another character and the characters reach the pieces unchanged.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    encode = lambda texts: model.encode(texts, out_type=int, add_bos=False, add_eos=False, num_threads=1)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    entries = tuple(bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names))
    white = lambda c: c == "▁" or c.isspace()
    parted = all(not (x[i] in "▁\n" and not white(x[i - 1])) for x in names for i in range(1, len(x)))
    odd = "ﬁ½Å e\u0301  \u3000①"
    kept = b"".join(entries[i] for i in encode([odd])[0]) == (" " + odd).encode()
    lead = encode(["a"])[0]  # stands before a chunk, as the space would else be added to it
    alone = parted and kept and len(lead) == 1
    return Side(lambda texts: encode(texts), (lambda texts: [x[1:] for x in encode(["a" + t for t in texts])]) if alone else None, entries)


def _byte_level_side(path: str) -> Side:
    """tokenizers is given the space. The byte-level pattern begins a pre-token at every white space after another character and looks at nothing before it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = True
    of = _byte_characters()
    vocabulary = found.get_vocab(with_added_tokens=True)
    entries = [b""] * (max(vocabulary.values()) + 1)
    for name, i in vocabulary.items():
        entries[i] = bytes(of[c] for c in name) if all(c in of for c in name) else name.encode()
    encode = lambda texts: [x.ids for x in found.encode_batch_fast(texts, add_special_tokens=False)]
    made = json.loads(found.to_str())
    cut = made["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made["normalizer"] and all(t["special"] for t in made["added_tokens"])
    return Side(lambda texts: encode([" " + t for t in texts]), encode if plain else None, tuple(entries))


@lru_cache(maxsize=4)
def load_side(path: str) -> Side:
    """A byte-level .json of tokenizers or a .model of sentencepiece; special strings in texts are plain text."""
    return _piece_side(path) if path.endswith(".model") else _byte_level_side(path)


def _id_type(side: Side) -> str:
    return "<u2" if len(side.entries) <= 1 << 16 else "<u4"


class _Encoder:
    """Ids of texts on both sides, chunk by chunk where both tokenizers allow it; ids of chunks met before are remembered."""

    def __init__(self, sides: list[Side]):
        self.sides, self.by_chunk = sides, all(s.chunk for s in sides)
        self.bytes = [np.array([len(x) for x in s.entries], np.int64) for s in sides]
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.size, self.kept = 0, np.zeros(0, bool)
        self.ids, self.start = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def _joined(self, side: int, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of chunks that don't end in white space, and how many each has: encoded as one text, in which their ends are ends of tokens. None if bytes are lost."""
        text = "".join(chunks)
        found = self.sides[side].chunk([text])[0] if chunks else []
        if b"".join([self.sides[side].entries[i] for i in found]) != text.encode():
            return None
        ids = np.array(found, np.int64)
        size = list(map(len, chunks)) if text.isascii() else [len(c.encode()) for c in chunks]
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes[side][ids]), np.cumsum(size)) + 1, prepend=0)

    def _apart(self, side: int, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their number of chunks encoded one by one, and whether each keeps its bytes."""
        found = self.sides[side].chunk(chunks) if chunks else []
        same = [b"".join([self.sides[side].entries[i] for i in own]) == c.encode() for c, own in zip(chunks, found, strict=True)]
        return np.fromiter(itertools.chain.from_iterable(found), np.int64), np.array(list(map(len, found)), np.int64), np.array(same, bool)

    def codes(self, chunks: list[str]) -> np.ndarray:
        known, distinct = self.code, dict.fromkeys(chunks)
        new = [c for c in distinct if c not in known]
        if new and self.size + sum(map(len, new)) > REMEMBERED:
            self.forget()
            new = list(distinct)
        if new:
            closed, open_ = [c for c in new if not c[-1].isspace()], [c for c in new if c[-1].isspace()]
            joined = [self._joined(i, closed) for i in range(2)]
            if None in joined:
                closed, open_, joined = [], new, [self._joined(i, []) for i in range(2)]
            alone = [self._apart(i, open_) for i in range(2)]
            for i in range(2):
                self.ids[i] = np.concatenate((self.ids[i], joined[i][0].astype(np.int32), alone[i][0].astype(np.int32)))
                self.start[i] = np.concatenate((self.start[i], self.start[i][-1] + np.cumsum(np.concatenate((joined[i][1], alone[i][1])))))
            self.kept = np.concatenate((self.kept, np.ones(len(closed), bool), alone[0][2] & alone[1][2]))
            self.code.update(zip([*closed, *open_], range(len(self.code), len(self.code) + len(new)), strict=True))
            self.size += sum(map(len, new))
        return np.fromiter(map(self.code.__getitem__, chunks), np.int64, len(chunks))

    def packed(self, texts: list[str]) -> list[pa.Array]:
        """Each text's ids on each side, as bytes (``_id_type``); empty for texts that are empty or that a side doesn't keep byte by byte."""
        out = []
        for (ids, edge), side in zip(self.ids_of(texts) if self.by_chunk else self._whole(texts), self.sides, strict=True):
            data = ids.astype(_id_type(side))
            out.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((edge * data.itemsize).astype(np.int32)), pa.py_buffer(data)]))
        return out

    def ids_of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of all texts on each side, and where each text's begin."""
        parts = [CHUNK.findall(" " + t) if t else [] for t in texts]
        edge = np.concatenate(([0], np.cumsum(list(map(len, parts)), dtype=np.int64)))
        code = self.codes(list(itertools.chain.from_iterable(parts)))
        lost = np.diff(np.concatenate(([0], np.cumsum(~self.kept[code])))[edge]) > 0
        code = code[~np.repeat(lost, np.diff(edge))]
        edge = np.concatenate(([0], np.cumsum(np.where(lost, 0, np.diff(edge)))))
        out = []
        for ids, start in zip(self.ids, self.start, strict=True):
            n = np.diff(start)[code]
            upto = np.concatenate(([0], np.cumsum(n)))
            out.append((ids[np.repeat(start[:-1][code] - upto[:-1], n) + np.arange(upto[-1])], upto[edge]))
        return out

    def _whole(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        full = [i for i, x in enumerate(texts) if x]
        found = [[()] * len(texts) for _ in self.sides]
        for i, *ids in zip(full, *(side.whole([texts[i] for i in full]) if full else [] for side in self.sides), strict=True):
            text = (" " + texts[i]).encode()
            if all(b"".join([side.entries[x] for x in own]) == text for side, own in zip(self.sides, ids, strict=True)):
                for out, own in zip(found, ids, strict=True):
                    out[i] = own
        return [(np.fromiter(itertools.chain.from_iterable(x), np.int64), np.concatenate(([0], np.cumsum(list(map(len, x)), dtype=np.int64)))) for x in found]


def _encode(path_a: str, path_b: str, characters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder([load_side(p) for p in (path_a, path_b)])
        for batch in batches:
            sizes = np.cumsum(batch.column("size").to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + characters, "right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("row"), *encoder.packed([x or "" for x in part.column("text").to_pylist()])], ["row", "a", "b"])
                lo = hi

    return run


# --- bitsets ----------------------------------------------------------------------------------------------------


def bitset(at: np.ndarray, n: int) -> np.ndarray:
    """64-bit words with the given bits of 0 to n - 1 set."""
    plane = np.zeros(-(-n // 64) * 64, bool)
    plane[at] = True
    return np.packbits(plane, bitorder="little").view(_U)


def select(words: np.ndarray) -> np.ndarray:
    """The places of all set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set before each place."""
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    word, bit = at >> 6, (at & 63).astype(_U)
    held = np.append(words, _U(0))[word] & ((_U(1) << bit) - _U(1))
    return before[word] + np.bitwise_count(held)


@dataclass
class Aligned:
    """Groups and links of consecutive texts. Of text i, groups [groups[i]:groups[i + 1]] and links [links[i]:links[i + 1]] are its own.

    ``ends``: a group's first A and B tokens that are not in it any more; ``link_a``, ``link_b``: a link's ids.
    """

    ends: np.ndarray
    groups: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    links: np.ndarray


def align(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Texts' ids, one after the other (those of text i at of[i]:of[i + 1]), with the bytes of every id; both sides have the same bytes in each text."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    n = int(end_a[-1]) + 1 if len(end_a) else 1
    bits_a, bits_b = bitset(end_a, n), bitset(end_b, n)
    shared, either = bits_a & bits_b, bits_a | bits_b
    text_end = np.concatenate(([0], end_a))[of_a]
    cuts, stops = select(shared), select(either)
    ends = np.stack((rank(bits_a, cuts + 1), rank(bits_b, cuts + 1)))
    return Aligned(ends, rank(shared, text_end + 1), a[rank(bits_a, stops)], b[rank(bits_b, stops)], rank(either, text_end + 1))


@lru_cache(maxsize=4)
def _names(n: int, inner: str, last: str) -> np.ndarray:
    """Each id's decimal digits with the sign that follows within a group, then with the one that ends it."""
    return np.array([*[f"{i}{inner}" for i in range(n)], *[f"{i}{last}" for i in range(n)]], object)


def written(found: Aligned, a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> list[str]:
    """Each text's groups as a1,a2|b1;a3|b2,b3 in decimal ids; a text without tokens is ''."""
    first = np.concatenate((np.zeros((2, 1), np.int64), found.ends), 1)
    in_a, in_b = np.diff(first[0]), np.diff(first[1])
    closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    closes_a[found.ends[0] - 1], closes_b[found.ends[1] - 1] = 1, 1
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.repeat(first[1, :-1], in_a)] = _names(n_a, ",", "|")[a + n_a * closes_a]
    out[np.arange(len(b)) + np.repeat(first[0, 1:], in_b)] = _names(n_b, ",", ";")[b + n_b * closes_b]
    at = (first[0] + first[1])[found.groups]
    return ["".join(out[x:y].tolist())[:-1] for x, y in zip(at, at[1:], strict=False)]


def _parts(batch: pa.RecordBatch, types: list[str], tokens: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Rows lo to hi of a batch with a, b and where each row's ids begin, by groups of bounded size."""
    values, where = [], []
    for name, kind in zip(("a", "b"), types, strict=True):
        column = batch.column(name)
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        width = np.dtype(kind).itemsize
        where.append(np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64) // width)
        values.append(np.frombuffer(data, kind, data.size // width) if data is not None else np.zeros(0, kind))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(where[0], where[0][lo] + tokens, "right")) - 1)
        yield lo, hi, [*[v[w[lo] : w[hi]].astype(np.int64) for v, w in zip(values, where, strict=True)], *[w[lo : hi + 1] - w[lo] for w in where]]
        lo = hi


def _sizes(path: str) -> np.ndarray:
    return np.array([len(x) for x in load_side(path).entries], np.int64)


# --- counts -----------------------------------------------------------------------------------------------------


def _count_links(path_a: str, path_b: str, tokens: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, types = [_sizes(p) for p in (path_a, path_b)], [_id_type(load_side(p)) for p in (path_a, path_b)]
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = merged = 0

        def merge() -> None:
            nonlocal keys, counts, held, merged
            found, back = np.unique(np.concatenate(keys), return_inverse=True)
            counts = [np.bincount(back, np.concatenate(counts), len(found)).astype(np.int64)]  # whole numbers below 2**53
            keys, held, merged = [found], 0, len(found)

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array((keys[0] >> 32).astype(np.int32)), pa.array((keys[0] & 0xFFFFFFFF).astype(np.int32)), pa.array(counts[0])], ["a", "b", "n"])
            keys[0], counts[0] = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return out

        for batch in batches:
            for _, _, ids in _parts(batch, types, tokens):
                found = align(*ids, *sizes)
                own, n = np.unique(found.link_a << 32 | found.link_b, return_counts=True)
                keys.append(own)
                counts.append(n)
                held += len(own)
                if held > most:
                    merge()
                    if merged > most:
                        yield batch_of()
        merge()
        yield batch_of()

    return run


def link_counts(tokens: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a, b, n, best``: how many links hold an id pair linked, and whether no other A id has more links with the B id."""
    found = tokens.select("a", "b").mapInArrow(lean(_count_links(path_a, path_b, GROUP_TOKENS, FLUSH)), "a int, b int, n long")
    found = checkpoint(found.groupBy("a", "b").agg(F.sum("n").alias("n")))
    top = found.groupBy("b").agg(F.max("n").alias("top"))
    return found.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))  # a row per entry of a vocabulary


# --- documents --------------------------------------------------------------------------------------------------


def _describe(path_a: str, path_b: str, common, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, types = [_sizes(p) for p in (path_a, path_b)], [_id_type(load_side(p)) for p in (path_a, path_b)]
        known, count, best = common.value
        for batch in batches:
            for lo, hi, ids in _parts(batch, types, tokens):
                found = align(*ids, *sizes)
                key = found.link_a << 32 | found.link_b
                at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                hit = known[at] == key if len(known) else np.zeros(len(key), bool)
                per_text = lambda x, edge=found.links: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[edge])
                n_best, total = (per_text(np.where(hit, x[at], 0) if len(known) else np.zeros(len(key), np.int64)) for x in (best, count))
                numbers = [np.diff(ids[2]), np.diff(ids[3]), np.diff(found.groups), np.diff(found.links), n_best, total]
                texts = written(found, ids[0], ids[1], len(sizes[0]), len(sizes[1]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("place", "row")], *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(texts, pa.string())], ["place", "row", *NUMBERS, "groups"])

    return run


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _rare_links(path_a: str, path_b: str, common, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, types = [_sizes(p) for p in (path_a, path_b)], [_id_type(load_side(p)) for p in (path_a, path_b)]
        known = common.value[0]
        for batch in batches:
            for lo, hi, ids in _parts(batch, types, tokens):
                found = align(*ids, *sizes)
                key = found.link_a << 32 | found.link_b
                at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                rare = np.flatnonzero(known[at] != key) if len(known) else np.arange(len(key))
                text = np.repeat(np.arange(hi - lo), np.diff(found.links))[rare]
                place = batch.column("place").slice(lo, hi - lo).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([place, pa.array((key[rare] >> 32).astype(np.int32)), pa.array((key[rare] & 0xFFFFFFFF).astype(np.int32))], ["place", "a", "b"])

    return run


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``place`` (a number of the row), ``row`` (the document's columns but the text) and the ids ``a`` and ``b`` as bytes, written once.

    A text that is null, empty, or whose joined tokens of either side differ from a space and the text has no ids.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(0).alias("none")).alias("row"), text.alias("text"), F.length(text).cast("long").alias("size"))
    found = packed.mapInArrow(lean(_encode(path_a, path_b, GROUP_CHARACTERS)), T.StructType().add("row", packed.schema["row"].dataType).add("a", "binary").add("b", "binary"))
    return store(found.withColumn("place", F.monotonically_increasing_id()))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, common_pairs: int = COMMON) -> DataFrame:
    """``row`` (the document's columns but the text), ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups``.

    ``path_a`` is a byte-level .json of tokenizers, which is given a space and the text, ``path_b`` a .model of sentencepiece, which adds the space
    itself; both without special tokens, and special strings in texts are plain text. ``groups`` lists the tokens between shared cuts as
    ``a1,a2|b1;a3|b2,b3``. A link is a pair of an A and a B token whose bytes overlap; the count of a pair of ids is how many links of all documents
    hold it; ``count_sum`` sums these over a document's links, ``n_best`` says how many have the highest count of their B id. Texts that are null,
    empty or not kept byte by byte by both have zeros and ''. Repeated rows are documents each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = encoded(docs, path_a, path_b)
    pairs = checkpoint(link_counts(tokens, path_a, path_b))
    floor = frequency_floor(pairs, "n", common_pairs)
    held = pairs.where(F.col("n") >= floor).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("key"), "n", "best").toArrow()  # common_pairs rows at most
    order = np.argsort(held.column("key").to_numpy())
    common = spark.sparkContext.broadcast((held.column("key").to_numpy()[order], held.column("n").to_numpy()[order], held.column("best").to_numpy()[order]))
    schema = T.StructType().add("place", "long").add("row", tokens.schema["row"].dataType)
    for name in NUMBERS:
        schema = schema.add(name, "long")
    found = tokens.mapInArrow(lean(_describe(path_a, path_b, common, GROUP_TOKENS)), schema.add("groups", "string"))
    if floor > 1:  # there are rarer pairs
        rare = tokens.select("place", "a", "b").mapInArrow(lean(_rare_links(path_a, path_b, common, GROUP_TOKENS)), "place long, a int, b int")
        rare = rare.join(pairs.where(F.col("n") < floor), ["a", "b"]).groupBy("place").agg(F.sum(F.col("best").cast("long")).alias("_best"), F.sum("n").alias("_sum"))
        found = found.join(rare, "place", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return found.select("row", *NUMBERS, "groups")
