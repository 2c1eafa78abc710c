"""Benchmark decontamination by greedy string tiling.

Texts are word sequences. Windows of ``min_match`` words (seeds) of the benchmark are a table
that documents are joined with: a document pairs with an item only if it shares
seeds at as many of the item's places as tiles of the wanted coverage must have. Each pair's
texts are then tiled: the longest match of unmarked words is marked on both sides,
again and again, until none of ``min_match`` words is left. Matches are found by
running Karp-Rabin hashes. The share of an item's words under tiles catches
passages whose parts come in another order.

Documents are read once for their seeds, behind a bitmap of the benchmark's seeds whose size is
bounded, and once more for the texts of the pairs. Neither table is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import lookup_join, materialise, small_batches, text_or_empty, without_ids
from waymark.llm.words import Words, mix, shingles, split_words, windows, without_nulls

MIN_MATCH, COVERAGE = 5, 0.5
#: The bitmap of seeds: at most 2 ** 27 bits, 16 MB.
BITMAP_BITS = 27
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Karp:
    """Window hashes of a sequence in which marked words match nothing any more."""

    def __init__(self, words: np.ndarray, salt: int):
        self.words = words.copy()
        self.salt = salt
        self._powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BASE)]))
        self._inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _INVERSE)]))
        self._sum()

    def _sum(self) -> None:
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum(self.words * self._powers[:-1])])

    def of(self, size: int) -> np.ndarray:
        return (self._sums[size:] - self._sums[:-size]) * self._inverse[: len(self._sums) - size]

    def mark(self, spans: list[tuple[int, int]]) -> None:
        for a, b in spans:
            self.words[a:b] = mix(np.arange(a, b, dtype=np.uint64) * np.uint64(2) + np.uint64(self.salt + 0xD6E8FEB86659FD93))
        self._sum()


def _longest(item: _Karp, doc: _Karp, least: int, most: int) -> int:
    """The length of the longest common window from ``least`` to ``most``, or 0."""
    shared = lambda size: bool(np.isin(doc.of(size), item.of(size)).any())
    if most < least or not shared(least):
        return 0
    low, high = least, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle) else (low, middle - 1)
    return low


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in document, words) of two sequences of word hashes, longest first.

    Of equally long matches, the first in the document, then in the item, is marked.
    Memory is linear in the words, however often they repeat, and no pair of places is listed.
    """
    left, right = _Karp(item, 0), _Karp(doc, 1)
    tiles: list[tuple[int, int, int]] = []
    size = min(len(item), len(doc))
    while size := _longest(left, right, min_match, size):
        # all matches of this length, in the order of the document; places once covered stay covered
        keys = left.of(size)
        order = np.argsort(keys, kind="stable")
        ordered, theirs = keys[order], right.of(size)
        where = np.flatnonzero(np.isin(theirs, keys))
        heads = np.searchsorted(ordered, theirs[where], "left")
        ends = np.searchsorted(ordered, theirs[where], "right")
        seen: dict[int, int] = {}
        free, until, fresh = np.ones(len(item), bool), 0, []
        for b, head, end in zip(where.tolist(), heads.tolist(), ends.tolist(), strict=True):
            if b < until:
                continue
            at = seen.get(head, head)
            while at < end and not free[order[at] : order[at] + size].all():
                at += 1
            seen[head] = at
            if at < end:
                a = int(order[at])
                fresh.append((a, b, size))
                free[a : a + size] = False
                until = b + size
        left.mark([(a, a + n) for a, _, n in fresh])
        right.mark([(b, b + n) for _, b, n in fresh])
        tiles += fresh
        size -= 1
    return tiles


def _near_seeds(item: np.ndarray, doc: np.ndarray, min_match: int) -> np.ndarray:
    """The document's words in windows that the item has, stretches kept apart by words of their own."""
    hit = np.isin(_Karp(doc, 1).of(min_match), _Karp(item, 0).of(min_match))
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + min_match, -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(kept) > 1) + 1
    return np.insert(doc[kept], gaps, mix(gaps.astype(np.uint64) + np.uint64(0xA0761D6478BD642F)))


def _seeds(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(row, hashes of some of its windows of ``size`` words, whether that was all) in the order of the rows.

    A long text comes in several parts, which carry the last words over the cuts.
    """
    carry = np.zeros(0, np.uint64)
    for window in windows(texts):
        words = split_words(window.texts, window.at, window.to)
        if not window.begins:
            words = replace(words, hashes=np.concatenate([carry, words.hashes]), first=words.first + np.append(0, len(carry)))
        parts, bounds = shingles(words, size)
        long_enough = np.diff(words.first) >= size
        carry = words.hashes[-(size - 1) :] if size > 1 else words.hashes[:0]
        for i in range(window.to - window.at):
            yield window.row + i, parts[bounds[i] : bounds[i + 1]] if long_enough[i] else parts[:0], window.ends


def _hashes(text: str) -> np.ndarray:
    words: Words = split_words(pa.array([text], pa.large_string()), 0, 1)
    return words.hashes


_TEXT_KEY = ["t1", "t2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and 96 bits that tell texts apart."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.crc32(text.cast("binary")).alias("t2"))


def _item_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """k, seed, times: the item's windows and how many of its places have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held = batch.column(0).to_numpy(), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for row, found, _ in _seeds(without_nulls(batch.column(1)), min_match):
                held.append((np.full(len(found), keys[row]), found))
            k, seed = (np.concatenate(c) for c in zip(*held, strict=True))
            yield pa.record_batch([pa.array(k), pa.array(seed.view(np.int64))], names=["k", "seed"])

    return items.select("k", "text").mapInArrow(run, "k long, seed long").groupBy("k", "seed").agg(F.count(F.lit(1)).alias("times"))


def _bitmap(seeds: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Bits set at the leading bits of every seed: of a thousand others, one may pass while the benchmark is small."""
    bits = min(BITMAP_BITS, max(16, int(count).bit_length() + 10))
    at = F.shiftrightunsigned("seed", 64 - bits)
    words = seeds.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64), bits


def _hits(keyed: DataFrame, bitmap: np.ndarray, bits: int, min_match: int) -> DataFrame:
    """id, text key and distinct seeds of documents whose seeds the bitmap lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists, held = [], [], []
            for row, found, done in _seeds(without_nulls(batch.column(1)), min_match):
                at = found >> np.uint64(64 - bits)
                held.append(found[(bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0])
                if done:
                    whole = np.unique(np.concatenate(held)) if len(held) > 1 else np.unique(held[0])
                    held = []
                    if len(whole):
                        rows.append(row)
                        lists.append(whole.view(np.int64))
            pick = pa.array(rows, pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *lists]), pa.int64())
            yield pa.record_batch(
                [*(batch.column(i).take(pick) for i in (0, 2, 3)), pa.ListArray.from_arrays(offsets, flat)], names=["id", *_TEXT_KEY, "seeds"]
            )

    small_batches(keyed.sparkSession)
    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"id {kind}, t1 long, t2 long, seeds array<long>")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
) -> DataFrame:
    """Rows (doc_id, item_id, matched_words, item_words, tiles, coverage) with enough of an item tiled.

    Items of fewer than ``min_match`` words, null and empty ones included, can't be
    matched and never appear; neither do documents that short. Repeated rows on
    either side give repeated rows; equal texts are tiled once. Ids of any type pass through, null ones
    stay null. A very long document's seeds are read in windows; tiling holds one document's
    text and words. Empty tables give an empty result; other columns are ignored.
    """
    numbered = benchmark.select(F.monotonically_increasing_id().alias("k"), F.col(item_col).alias("item_id"), text_or_empty(item_text_col).alias("text"))
    items = materialise(numbered, "items")
    seeds = materialise(_item_seeds(items, min_match), "seeds")
    sizes = materialise(seeds.groupBy("k").agg((F.sum("times") + min_match - 1).alias("item_words")), "sizes")
    keyed = _keyed(docs, id_col, text_col)
    bitmap, bits = _bitmap(seeds, seeds.count())
    hits = materialise(_hits(keyed, bitmap, bits, min_match), "hits")
    once = hits.groupBy(*_TEXT_KEY).agg(F.first("seeds").alias("seeds"))
    met = lookup_join(once.select(*_TEXT_KEY, F.explode("seeds").alias("seed")), seeds, ["seed"], "inner")
    shared = met.groupBy(*_TEXT_KEY, "k").agg(F.sum("times").alias("shared"))
    # a tile of m words holds m - min_match + 1 seeds, at least m / min_match
    needed = F.ceil(F.col("item_words") * coverage / min_match)
    pairs = materialise(lookup_join(shared, sizes, ["k"], "inner").where(F.col("shared") >= needed).select(*_TEXT_KEY, "k", "item_words"), "pairs")
    named = materialise(pairs.select(*_TEXT_KEY).distinct(), "texts")
    texts = materialise(lookup_join(keyed, named, _TEXT_KEY, "left_semi").groupBy(*_TEXT_KEY).agg(F.min("text").alias("text")), "found")
    # texts are never broadcast by a number of rows, which would not bound their bytes
    met = pairs.join(texts, _TEXT_KEY).join(items.select("k", F.col("text").alias("item_text")), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for item_text, text in zip(batch.column(4), batch.column(5), strict=True):
                item = _hashes(item_text.as_py())
                found = tile(item, _near_seeds(item, _hashes(text.as_py()), min_match), min_match)
                counts.append((sum(t[2] for t in found), len(found)))
            arrays = [pa.array([c[i] for c in counts], pa.int32()) for i in (0, 1)]
            yield pa.record_batch([*(batch.column(i) for i in range(4)), *arrays], names=[*_TEXT_KEY, "k", "item_words", "matched_words", "tiles"])

    spread = met.select(*_TEXT_KEY, "k", F.col("item_words").cast("int").alias("item_words"), "item_text", "text")
    tiled = spread.mapInArrow(run, "t1 long, t2 long, k long, item_words int, matched_words int, tiles int")
    tiled = materialise(tiled.where(F.col("matched_words") >= coverage * F.col("item_words")), "tiled")
    rows = lookup_join(lookup_join(hits.select("id", *_TEXT_KEY), tiled, _TEXT_KEY, "inner"), items.select("k", "item_id"), ["k"], "inner")
    return rows.select(
        F.col("id").alias("doc_id"), "item_id", "matched_words", "item_words", "tiles", (F.col("matched_words") / F.col("item_words")).alias("coverage")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without those that contain enough of any item; rows with a null id stay. All columns stay."""
    found = overlaps(docs, benchmark, id_col, text_col, **parameters).select("doc_id").distinct()
    return without_ids(docs, id_col, materialise(found, "leaks"))
