"""Vectorised text kernels for Arrow batches: word spans, word hashes, shingle sets.

A batch's strings lie in one byte buffer. Documents are taken in groups that fit
a cache, so memory does not follow the batch size, and every step is a numpy
operation over the whole group. A single text is never split across groups,
however long it is.

Hashes have 64 bits. A word's hash is a polynomial over a random 64-bit value
per byte, read off one running sum; that of a word longer than LONG_WORD bytes, where
patterns exist that such polynomials don't tell apart, is a BLAKE2 digest. It depends on
the word's (lower-cased) bytes and length alone, so that equal words have equal hashes in every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 18
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64, grown as far as a task needs."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, _U)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = _U(pow(self.base, len(self.table), 1 << 64))
            self.table = np.concatenate((self.table, self.table * step))
        return self.table[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(pow(_BASE, -1, 1 << 64))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and the value that each byte adds (upper-case A-Z as lower-case where folded)."""

    word: np.ndarray
    value: np.ndarray
    fold: bool


def alphabet(separators: bytes, fold: bool) -> Alphabet:
    word = np.ones(256, bool)
    word[np.frombuffer(separators, np.uint8)] = False
    value = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
    if fold:
        source = np.arange(256)
        source[65:91] += 32
        value = value[source]
    return Alphabet(word, value, fold)


#: [^\x20\x09-\x0D]+ ; the second also lower-cases A-Z; the third is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
PLAIN = alphabet(b"\x20\x09\x0a\x0b\x0c\x0d", fold=False)
FOLDED = alphabet(b"\x20\x09\x0a\x0b\x0c\x0d", fold=True)
ALNUM = alphabet(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)


@dataclass
class Group:
    """Consecutive texts of a batch. Text i of the group has bytes[offsets[i]:offsets[i + 1]]; a null is empty."""

    first: int
    bytes: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[Group]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    width = np.int32 if pa.types.is_string(texts.type) else np.int64
    offsets = np.frombuffer(where, width, n + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Group(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a group in order: byte spans, hashes; those of text i are [bounds[i]:bounds[i + 1]]."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def words(group: Group, letters: Alphabet, kinds: np.ndarray | None = None, parted: np.ndarray | None = None) -> Words:
    """The words of a group. In texts that ``parted`` marks, they are also cut where the kind of byte changes (``kinds``, by byte)."""
    data = group.bytes
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = letters.word[data]
    cut = np.zeros(n + 1, bool)  # at i: no word goes on from byte i - 1 to byte i
    cut[1:] = ~inside[:n]
    cut[group.offsets] = True
    if kinds is not None and n:
        kind = kinds[data]
        cut[1:n] |= (kind[1:] != kind[:-1]) & np.repeat(parted, np.diff(group.offsets))[1:]
    start = np.flatnonzero(inside & cut)
    cut |= ~inside
    end = np.flatnonzero(inside[:n] & cut[1:]) + 1
    total = np.zeros(n + 1, _U)
    np.cumsum(letters.value[data] * _UP.upto(n), out=total[1:])
    code = mix((total[end] - total[start]) * _DOWN.upto(n + 1)[start] ^ (end - start).astype(_U))
    for i in np.flatnonzero(end - start > LONG_WORD):
        own = data[start[i] : end[i]].tobytes()
        code[i] = int.from_bytes(hashlib.blake2b(own.lower() if letters.fold else own, digest_size=8).digest(), "little")
    return Words(start, end, code, np.searchsorted(start, group.offsets, "left"))


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive word hashes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = codes[:n]
    for j in range(1, k):
        out = mix(out) + codes[j : n + j]
    return mix(out)


def shingle_set(codes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles; of fewer words, their whole sequence is the only one."""
    if len(codes) == 0:
        return np.zeros(0, _U)
    if len(codes) < k:
        return windows(codes, len(codes)) ^ _U(len(codes))
    return np.unique(windows(codes, k))


def set_name(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit names of a set of hashes."""
    with np.errstate(over="ignore"):
        a, b = mix(tokens).sum(dtype=_U), mix(tokens ^ _U(_BASE)).sum(dtype=_U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
