"""Vectorised byte and word work on Arrow text columns, used inside tasks by the operators of this subpackage.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, as in the contracts; UTF-8 keeps its multi-byte characters
clear of those bytes. All functions work on slices of whole documents, half a MB by default (each byte takes some ten numbers of eight
bytes on the way), so memory does not grow with a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Multiplier of the polynomial word hash and its inverse modulo 2**64.
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def text_slices(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of whole documents of about ``limit`` bytes; a longer document is alone.
    A null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        yield row, data[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


def fmix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POW or len(_POW["up"]) < n + 1:
        size = max(n + 1, 1 << 19)
        for name, base in (("up", _R), ("down", _R_INV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["up"], _POW["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the slice, and the number of words before each document (len(offsets))."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = solid & cut[:-1]
    first[1:] |= solid[1:] & ~solid[:-1]
    last = solid & cut[1:]
    last[:-1] |= solid[:-1] & ~solid[1:]
    last[-1] = solid[-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; two of n different words agree with probability about n**2 / 2**65."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:len(data)], out=total[1:])
    return fmix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, it and the ``order`` bytes before it in its document as one number (zeros before the start)."""
    data = LOWER[data].astype(U64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.copy()
    for back in range(1, order + 1):
        before = np.zeros(len(data), U64)
        before[back:] = data[:-back] if back < len(data) else 0
        before[place < back] = 0
        out |= before << U64(8 * back)
    return out


class Lookup:
    """Open-addressing table from 64-bit keys to row numbers in order of arrival, probed for whole arrays at once.
    It holds twice as many slots as keys at least."""

    def __init__(self, keys: np.ndarray | None = None):
        self.size = 0
        self._empty(4)
        if keys is not None:
            self.add(keys)

    def _empty(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.rows = np.full(1 << bits, -1, dtype=np.int32)

    def add(self, keys: np.ndarray) -> None:
        """Take in new distinct keys; they get the next row numbers."""
        keys = keys.astype(U64)
        rows = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        if self.size * 2 > self.mask:
            held = self.rows >= 0
            keys, rows = np.concatenate([self.keys[held], keys]), np.concatenate([self.rows[held], rows])
            self._empty(int(self.size * 2).bit_length())
        slot = self._slot(keys)
        while len(rows):
            free = self.rows[slot] < 0
            # of the keys that want one free slot, the last written one gets it
            self.rows[slot[free]] = rows[free]
            won = self.rows[slot] == rows
            self.keys[slot[won]] = keys[won]
            keys, rows, slot = keys[~won], rows[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is not in the table."""
        slot = self._slot(keys)
        out = self.rows[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            row = self.rows[slot]
            hit = (self.keys[slot] == keys[todo]) | (row < 0)
            out[todo[hit]] = row[hit]
            todo, slot = todo[~hit], slot[~hit]
        return out


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i, along the first axis; empty ranges give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=values.dtype if values.dtype.kind in "iu" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
