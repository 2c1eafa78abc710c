"""Words, word hashes and shingles of many texts at once, from Arrow buffers with numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return, with A-Z lower-cased. Hashes are 64-bit and the same in every
process.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LONG = 48
_BASE = np.uint64(0x100000001B3)
_SEED = np.uint64(0xCBF29CE484222325)
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts: text i has those from ``first[i]`` up to ``first[i + 1]``."""

    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray
    text_at: np.ndarray
    prefixes: dict[int, np.ndarray] = field(default_factory=dict)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes of text, or a single longer one."""
    offsets = _offsets(texts)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def split_words(texts: pa.Array, at: int, to: int, prefixes: Sequence[int] = ()) -> Words:
    """Words of rows ``at`` up to ``to`` of a string array without nulls.

    ``prefixes``: lengths in bytes for which ``Words.prefixes`` gets the hash of a
    word's beginning (0 for words no longer than it).
    """
    offsets = _offsets(texts)[at : to + 1]
    base, stop = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[base:stop] if data is not None and stop > base else np.zeros(0, np.uint8)
    bounds = offsets - base
    low = _LOWER[raw]
    inside = ~_SPACE[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = bounds[1:] - 1
    last = last[last >= 0]
    closes[last] = inside[last]
    ends = np.flatnonzero(closes) + 1
    hashes, found = _hash(low, starts, ends, prefixes)
    return Words(np.searchsorted(starts, bounds), hashes, starts, ends, raw, bounds, found)


def _hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: Sequence[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    sizes = ends - starts
    found = {k: np.zeros(len(starts), np.uint64) for k in prefixes}
    # longest words first, so that those which have a byte k are a slice
    capped = np.minimum(sizes, _LONG).astype(np.uint8)
    order = np.argsort(capped, kind="stable")[::-1]
    longer = len(starts) - np.cumsum(np.bincount(capped, minlength=1))
    at, value = starts.take(order), np.full(len(starts), _SEED)
    for k, live in enumerate(longer[:-1].tolist()):
        if k in found:
            found[k][order[:live]] = mix(value[:live] + np.uint64(k))
        value[:live] ^= low.take(at[:live])
        value[:live] *= _BASE
        at[:live] += 1
    out = np.empty_like(value)
    out[order] = value
    out = mix(out + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = xxhash.xxh64_intdigest(low[starts[i] : ends[i]].tobytes())
    return out, found


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, and the ranges of texts in them.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    h, first = words.hashes, words.first
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(counts)), made)
    begin = first[:-1][owner] + np.arange(bounds[-1]) - bounds[:-1][owner]
    out = np.zeros(len(begin), np.uint64)
    for k in range(size):
        inside = counts[owner] > k
        at = np.minimum(begin + k, max(len(h) - 1, 0))
        out = np.where(inside, mix(out * np.uint64(3) + h[at] + np.uint64(k + 1)), out) if len(h) else out
    return out, bounds


def without_nulls(column: pa.Array) -> pa.Array:
    return column.fill_null("") if column.null_count else column


@dataclass
class Window:
    """Rows ``at`` up to ``to`` of ``texts``, the first of which is row ``row`` of its batch.

    ``begins`` and ``ends`` are False for a window that goes on from the one before, or
    is followed by another, of the same text.
    """

    texts: pa.Array
    at: int
    to: int
    row: int
    begins: bool = True
    ends: bool = True


def windows(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Window]:
    """Texts in runs of at most ``most`` bytes; a longer text is cut at white space.

    Only a single word longer than ``most`` makes a longer window.
    """
    for at, to in slices(texts, most):
        lo, hi = _offsets(texts)[[at, to]]
        if hi - lo <= most:
            yield Window(texts, at, to, at)
            continue
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
        a = 0
        while a < len(raw):
            b = _cut(raw, a, most)
            piece = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, b - a], np.int32)), pa.py_buffer(raw[a:b])])
            yield Window(piece, 0, 1, at, a == 0, b == len(raw))
            a = b


def _cut(raw: np.ndarray, a: int, most: int) -> int:
    """Just behind the last white space that a window from ``a`` can hold, or else behind the next one."""
    if len(raw) - a <= most:
        return len(raw)
    inside = np.flatnonzero(_SPACE[raw[a : a + most]])
    if len(inside):
        return a + int(inside[-1]) + 1
    for b in range(a + most, len(raw), most):
        later = np.flatnonzero(_SPACE[raw[b : b + most]])
        if len(later):
            return b + int(later[0]) + 1
    return len(raw)


def lowered(words: Words, pick: np.ndarray) -> pa.Array:
    """The bytes of some words, A-Z lower-cased, as an Arrow array."""
    sizes = words.ends[pick] - words.starts[pick]
    ends = np.cumsum(sizes)
    at = np.repeat(words.starts[pick] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[words.raw[at]])])
