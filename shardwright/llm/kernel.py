"""Vectorised work on the UTF-8 bytes of Arrow string columns: no Python string is made.

Everything goes over slices of about SLICE bytes, so memory per task doesn't grow with the batch or with a text's
length (but for 8 bytes a word where a caller needs all of a document's words)."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes of words: all but space and \x09 to \x0D.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's rows, and n + 1 offsets into them; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def runs(offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes together, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def slices(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SLICE bytes that cut no word of a document."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + SLICE, n)
        while hi < n and word[data[hi]] and word[data[hi - 1]]:
            k = int(np.searchsorted(offs, hi))
            if k < len(offs) and offs[k] == hi:
                break
            rest = np.flatnonzero(~word[data[hi : hi + SLICE]])
            step = int(rest[0]) if len(rest) else SLICE
            nxt = int(offs[k]) if k < len(offs) else n
            hi = min(hi + step, nxt, n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, within the slice, of the runs of w that no document's end cuts."""
    cut = offs[(offs > lo) & (offs < hi)] - lo
    before = np.empty(len(w), bool)
    before[0] = False
    before[1:] = w[:-1]
    before[cut] = False
    after = np.empty(len(w), bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[cut - 1] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def span_hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of a slice: a polynomial from prefix sums, mixed."""
    n = len(low)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INV, n + 1)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all rows, in order, and the row of each."""
    hs, at = [], []
    for lo, hi in slices(data, offs, WORD):
        part = data[lo:hi]
        s, e = word_spans(data, offs, lo, hi, WORD[part])
        if len(s):
            hs.append(span_hash(LOWER[part], s, e))
            at.append(s + lo)
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.searchsorted(offs, np.concatenate(at), "right") - 1


def unique_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def release() -> None:
    """Gives memory that is free by now back to the system: workers live on while other stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """The mapper over batches, with its memory given back at its end, when its own variables are gone too."""

    def lean_run(batches):
        yield from run(batches)
        release()

    return lean_run


class Lookup:
    """Places of keys in a sorted array of distinct 64-bit integers: a hashed index first, binary search for the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(8, int(max(len(keys), 1) - 1).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.index = np.zeros(1 << bits, np.int32)
        self.index[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self.index[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            far = np.searchsorted(self.keys, keys[miss])
            far[far == len(self.keys)] = 0
            at[miss] = np.where(self.keys[far] == keys[miss], far, -1)
        return at
