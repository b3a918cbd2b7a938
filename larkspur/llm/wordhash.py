"""Hashes of the words and n-grams of many texts at once, in numpy, within a bounded memory.

A run of texts becomes one array of symbols (bytes or code points). With prefix sums of
symbol * BASE^position (mod 2^64), the hash of any slice is a difference of two sums times
BASE^-start, so all words cost a few vector operations and no Python per word. A text longer than SEGMENT
symbols is hashed piece by piece, cut between its words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Symbols that are hashed at once; temporaries take some tens of bytes for each.
SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class Symbols:
    """Symbols of a run of texts; offsets[i]..offsets[i+1] is text i."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets.astype(np.int64)
        self.symbols = symbols
        power, self._unpower = _powers(len(symbols) + 1)
        self._sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each slice, the same wherever it stands."""
        return mix((self._sums[ends] - self._sums[starts]) * self._unpower[starts] + (ends - starts).astype(np.uint64))

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of inside that don't cross texts; runs first[i]..first[i+1] are of text i."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        at = self.offsets[self.offsets < n]
        begin[at] = inside[at]
        at = at[at > 0] - 1
        end[at] = inside[at]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)


def slice_hash(symbols: np.ndarray, most: int = SEGMENT) -> np.uint64:
    """The hash that Symbols gives a slice, of any length, from pieces of `most` symbols."""
    total, at = 0, 0
    for i in range(0, len(symbols), most):
        part = symbols[i : i + most]
        power = _powers(len(part) + 1)[0]
        piece = int(((part.astype(np.uint64) + np.uint64(1)) * power[:-1]).sum(dtype=np.uint64))
        total, at = total + piece * pow(int(_BASE), i, 1 << 64), i + len(part)
    return mix(np.array([(total + at) % (1 << 64)], np.uint64))[0]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and where each text begins in them."""
    if pa.types.is_large_string(texts.type):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    else:
        texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def text_runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows (from, to) whose texts have `most` bytes together, or one longer text."""
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, last
        row = last


def segments(data: np.ndarray, most: int, inside: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Slices of about `most` symbols of a long text that end where inside is false, so that no run of it is cut; a longer run is a slice of its own."""
    at = 0
    while at < len(data):
        to = min(at + most, len(data))
        if to < len(data):
            gap = np.flatnonzero(~inside(data[at:to]))
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                while to < len(data):
                    gap = np.flatnonzero(~inside(data[to : to + most]))
                    to = to + int(gap[0]) if len(gap) else min(to + most, len(data))
                    if len(gap):
                        break
        yield at, to
        at = to


def _words(part: np.ndarray, offsets: np.ndarray, tail: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(part) > 2 * most:  # one word
        last = part[-tail:] if tail else part[:0]
        return np.array([slice_hash(part, most)]), np.array([slice_hash(last)]), np.searchsorted(np.zeros(1, np.int64), offsets)
    s = Symbols(part, offsets)
    starts, ends, first = s.runs(~BLANK[part])
    return s.hashes(starts, ends), s.hashes(np.maximum(starts, ends - tail), ends) if tail else starts[:0].astype(np.uint64), first


def word_runs(texts: pa.Array, *, lower: bool, tail: int = 0, most: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the words (runs of bytes other than ASCII white space) of a string column, null as empty, some texts at a time.

    Yields (first row, rows, hashes, hashes of the last `tail` bytes of each word, first word of each text and the end).
    """
    data, offsets = text_bytes(texts)
    for row, last in text_runs(offsets, most):
        part, inside = data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        if lower:
            part = LOWER[part]
        if len(part) <= most:
            hashes, tails, first = _words(part, inside, tail, most)
        else:
            found = [_words(part[i:j], np.array([0, j - i]), tail, most)[:2] for i, j in segments(part, most, lambda x: ~BLANK[x])]
            hashes, tails = (np.concatenate(x) for x in zip(*found, strict=True))
            first = np.array([0, len(hashes)])
        yield row, last - row, hashes, tails, first


def windows(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, and where those of each text begin; a text of 1 to n-1 words has one, of all its words."""
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(made, out=out_first[1:])
    at = np.repeat(first[:-1] - out_first[:-1], made) + np.arange(out_first[-1])
    have = np.repeat(counts, made)
    total = np.zeros(len(at), np.uint64)
    if len(words):
        for k, c in enumerate(mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)):
            x = words[np.minimum(at + k, len(words) - 1)] * c
            total += x if k == 0 else np.where(have > k, x, np.uint64(0))
    return mix(total + np.minimum(have, n).astype(np.uint64)), out_first


def room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a longer copy that ends in zeros, with space for n; it doubles, so that growing costs little."""
    if n <= len(a):
        return a
    out = np.zeros(max(1 << 10, 1 << (n - 1).bit_length()), a.dtype)
    out[: len(a)] = a
    return out


class KeyTable:
    """Distinct 64-bit hashes and their places, in the order in which they were added; open addressing, looked up and filled by whole arrays."""

    def __init__(self, keys: np.ndarray | None = None):
        self.keys = np.zeros(0, np.uint64)
        self.n = 0
        self._slots = np.full(1 << 10, -1, np.int32)
        if keys is not None:
            self.add(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if there is none."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        mask, left = len(self._slots) - 1, None
        at = (keys & np.uint64(mask)).astype(np.int64)
        while True:
            place = self._slots[at]
            hit = self.keys[place] == (keys if left is None else keys[left])
            hit &= place >= 0
            if left is None:
                out[hit] = place[hit]
                left = np.flatnonzero((place >= 0) & ~hit)
                at = at[left]
            else:
                out[left[hit]] = place[hit]
                more = (place >= 0) & ~hit
                left, at = left[more], at[more]
            if not len(left):
                return out
            at = (at + 1) & mask

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that it doesn't have."""
        n = self.n + len(keys)
        self.keys = room(self.keys, n)
        self.keys[self.n : n] = keys
        if 2 * n > len(self._slots):
            self._slots = np.full(1 << (2 * n).bit_length(), -1, np.int32)
            new = np.arange(n)
        else:
            new = np.arange(self.n, n)
        self.n = n
        mask = len(self._slots) - 1
        at = (self.keys[new] & np.uint64(mask)).astype(np.int64)
        while len(new):
            free = np.flatnonzero(self._slots[at] < 0)
            self._slots[at[free]] = new[free]  # of several for one slot, one wins
            lost = self._slots[at] != new
            new, at = new[lost], (at[lost] + 1) & mask


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; when a task ends, the worker, which lives on for other tasks, hands its free memory back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
