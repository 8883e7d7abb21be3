"""Words and n-gram hashes of many texts at once, on the bytes of Arrow string columns.

A UTF-8 byte of 0x80 or more always belongs to a character outside ASCII, so a word
class that is defined on ASCII alone can be decided byte by byte. Hashes depend on
content only: never on the chunk, the worker or the position.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1_000_000
HASH_BYTES = 1 << 20

_BYTES = np.arange(256)
#: `[^\x20\x09-\x0D]`
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: A-Z to a-z, all else unchanged
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM_VALUE = np.random.default_rng(7062024).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i < n; kept between calls and doubled on demand."""
    global _powers, _inverse
    while len(_powers) < n:
        m = len(_powers)
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_MULTIPLIER, m, 2**64))])
        _inverse = np.concatenate([_inverse, _inverse * np.uint64(pow(_MULTIPLIER, -m, 2**64))])
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Texts:
    """Some whole texts: their rows in the batch, bytes, and byte offsets (one more than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def split_texts(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Groups of whole texts of at most `chunk_bytes`, or one longer text. Nulls count as empty.

    The batch's own buffers are read; after the batch, memory that it took goes back to the system.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    valid = np.asarray(column.is_valid())
    offsets, data = _buffers(column)
    if column.null_count and np.diff(offsets)[~valid].any():
        offsets, data = _buffers(pc.fill_null(column, ""))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1)
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], valid[lo:hi])
        lo = hi
    release_memory()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64), np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)


_trim = None


def release_memory() -> None:
    """Workers live long and keep what the allocators hold; give it back."""
    global _trim
    pa.default_memory_pool().release_unused()
    if _trim is None:
        try:
            _trim = ctypes.CDLL(None).malloc_trim
        except AttributeError:  # another C library
            _trim = lambda _: 0
    _trim(0)


@dataclass
class Words:
    """start, end: byte positions; first: per text the index of its first word, with the total at the end."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def hashes(self) -> np.ndarray:
        """A hash per word; blocks of whole words bound what a very long text needs beside its words."""
        out = np.zeros(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            lo = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, lo + HASH_BYTES, "right")))
            first, size = self.start[i:j] - lo, self.end[i:j] - self.start[i:j]
            powers, inverse = _power_tables(int(self.end[j - 1]) - lo)
            sums = _BYTE_VALUE[self.data[lo : self.end[j - 1]]]
            sums *= powers[: len(sums)]
            np.cumsum(sums, out=sums)
            h = sums[first + size - 1]
            h[1:] -= sums[first[1:] - 1]
            h *= inverse[first]
            out[i:j] = mix(h + size.astype(np.uint64))
            i = j
        return out

    def span(self, i: int, n: int, sep: bytes = b" ") -> bytes:
        """Words i to i + n, joined."""
        d = self.data
        return sep.join(d[a:b].tobytes() for a, b in zip(self.start[i : i + n], self.end[i : i + n], strict=True))


def words_of(texts: Texts, kind: np.ndarray, lower: bool = False) -> Words:
    data = LOWER[texts.data] if lower else texts.data
    n = len(data)
    inside = kind[data]
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts.offsets), np.int64), data)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, texts.offsets), data)


def grams(h: np.ndarray, k: int, stream: int = 0) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places, and those where a text ends sooner, are meaningless."""
    out = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):
        out[: len(h) - j] += h[j:] * _GRAM_VALUE[(j + 31 * stream) % 64]
    return mix(out + np.uint64(k))


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """One list per text from a flat array and how many of it belong to each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def smallest(g: np.ndarray, width: int) -> np.ndarray:
    """For each place, the smallest of the `width` values from it on (fewer at the end)."""
    best = g.copy()
    for j in range(1, min(width, len(g))):
        np.minimum(best[: len(g) - j], g[j:], out=best[: len(g) - j])
    return best
