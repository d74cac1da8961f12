"""Word and shingle hashing of Arrow text batches in numpy, without a Python object per word.

A batch's UTF-8 bytes are mapped through a 256-entry table (0 marks a separator byte), word bounds come
from the flag changes, and word hashes are differences of a running polynomial sum over random byte
values modulo 2**64, so a batch costs a few passes over its bytes whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 2 << 20


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def alnum_table() -> np.ndarray:
    """Words of digits, letters and bytes over 0x7F, A-Z lower-cased; all else separates."""
    t = _lower_table()
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[128:] = True
    keep[65:91] = True
    t[~keep] = 0
    return t


def space_table(lower: bool) -> np.ndarray:
    """Words of all but space, tab, line feed, vertical tab, form feed and carriage return.

    NUL is a word byte here, so it is mapped to 0xFF, which UTF-8 text never holds.
    """
    t = _lower_table() if lower else np.arange(256, dtype=np.uint8)
    t[0] = 255
    t[[32, 9, 10, 11, 12, 13]] = 0
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


_VALUES = _byte_values()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("i", inverse)):
            a = np.full(size, base & _MASK, dtype=U64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=U64)
    return _POWERS["p"], _POWERS["i"]


@dataclass
class Words:
    """Words of consecutive documents: bounds in bytes of ``data``, hashes, and each document's first word."""

    data: np.ndarray
    doc_bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document bounds of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``size`` bytes, or one longer document."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def slices(batch: pa.RecordBatch, column: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most ``size`` bytes of text, or one longer row, so that what is built from
    them and sent back stays small however long the texts are."""
    _, bounds = text_buffers(batch.column(column))
    for i, j in chunks(bounds, size):
        yield batch.slice(i, j - i)


def split_words(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    n = len(raw)
    bounds = np.asarray(bounds, np.int64)
    if n == 0:
        e = np.zeros(0, np.int64)
        return Words(raw, bounds, e, e, np.zeros(0, U64), np.zeros(len(bounds), np.int64))
    mapped = table[raw]
    word = mapped != 0
    inner = bounds[(bounds > 0) & (bounds < n)]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    power, inverse = _powers(n)
    run = np.empty(n + 1, U64)
    run[0] = 0
    np.cumsum(_VALUES[mapped] * power[:n], out=run[1:])
    h = mix((run[end] - run[start]) * inverse[start])
    return Words(raw, bounds, start, end, h, np.searchsorted(start, bounds, "left"))


def batches(column: pa.Array, table: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """(index of the first document, words) for every run of documents of a text column."""
    raw, bounds = text_buffers(column)
    for i, j in chunks(bounds, size):
        yield i, split_words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], table)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they stay in its document."""
    n = len(w.hash)
    last = np.repeat(w.first[1:], w.counts)
    ok = np.arange(n) + k <= last
    out = np.full(max(n - k + 1, 0), U64(k * 0x9E3779B97F4A7C15 & _MASK), U64)
    for j in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += w.hash[j : n - k + 1 + j]
    full = np.zeros(n, U64)
    full[: len(out)] = mix(out)
    return full, ok


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a short word sequence, of its own kind for each length."""
    acc = len(h) * 0x9E3779B97F4A7C15 & _MASK
    for x in h.tolist():
        acc = (acc * 0xD6E8FEB86659FD93 + x) & _MASK
    return int(mix(np.array([acc], U64))[0])


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each document's distinct k-word shingles as sorted hashes; shorter documents count as one shingle."""
    full, ok = windows(w, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif b > a:
            out.append(np.array([sequence_hash(w.hash[a:b])], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def as_int64(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, U64).view(np.int64)
