"""Best-fit packing planned on the histogram of lengths.

The plan is made over counts: best-fit decreasing places all pieces of a length
in runs of equal bins at once, so the driver handles at most ``capacity`` counts
and a plan whose size depends on the lengths, not on the documents. Pieces then
take the planned slots by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.bpe import encoder
from waymark.llm.store import materialise, ranked, small_batches, text_or_empty

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_RANK_BITS = 44


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its whole text's ids (null: none) and then ``end_id``, so an empty
    text gives one piece of length 1. Longer documents are cut into pieces of
    exactly ``capacity``; the remainder comes first, as piece 0. Repeated rows and
    null ids give pieces like others.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(text) + end
                view, total = memoryview(ids), len(ids) // 4
                start, size = 0, total % capacity or capacity
                piece = 0
                while start < total:
                    part = view[4 * start : 4 * (start + size)]
                    row = (key, piece, start, size, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype("int32")) if with_ids else row)
                    start, size, piece = start + size, capacity, piece + 1
            columns = list(zip(*out, strict=True)) or [[]] * (5 + with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(cut, schema)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, count, first sequence, offset).

    It opens as many sequences as best-fit decreasing piece by piece, which fills a bin before it
    turns to another one with the same room. A run says that the pieces of ``length`` with ranks from ``first rank`` on sit
    at ``offset`` in the sequences from ``first sequence`` on, one in each.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    sequences = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids doesn't fit in {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, capacity + 1) if open_bins[r]), None)
            if room is None:
                fresh = -(-left // (capacity // length))
                open_bins[capacity].append((sequences, fresh))
                sequences, room = sequences + fresh, capacity
            first, count = open_bins[room].pop()
            # the fullest bin that fits is the one just filled, as long as it fits another piece
            each = room // length
            bins = min(count, left // each)
            taken = [(first, bins, each)] if bins else []
            if bins < count and left - bins * each:
                taken.append((first + bins, 1, min(each, left - bins * each)))
            for start, n, layers in taken:
                for layer in range(layers):
                    runs.append((length, rank, n, start, capacity - room + layer * length))
                    left, rank = left - n, rank + n
                if room > layers * length:
                    open_bins[room - layers * length].append((start, n))
            used = sum(n for _, n, _ in taken)
            if used < count:
                open_bins[room].append((first + used, count - used))
    return runs


def assign_slots(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces; every other column stays."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan_best_fit(histogram, capacity))
    starts = np.asarray([(r[0] << _RANK_BITS) + r[1] for r in runs], "int64")
    first, offset = np.asarray([r[3] for r in runs], "int64"), np.asarray([r[4] for r in runs], "int64")
    bucket = max(128, sum(histogram.values()) // 16384)
    buckets = F.element_at(F.array(*[F.lit(-(-histogram.get(n, 1) // bucket)) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    rank = ranked(pieces, ["length"], order, "__wm_rank", buckets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rank_of = batch.column(names.index("__wm_rank")).to_numpy()
            key = (batch.column(names.index("length")).to_numpy() << _RANK_BITS) + rank_of
            run = np.searchsorted(starts, key, "right") - 1
            keep = [i for i, n in enumerate(names) if n != "__wm_rank"]
            arrays = [batch.column(i) for i in keep] + [pa.array(first[run] + key - starts[run]), pa.array(offset[run])]
            yield pa.record_batch(arrays, names=[names[i] for i in keep] + ["sequence_id", "offset"])

    slots = [f for f in rank.columns if f != "__wm_rank"]
    schema = ", ".join(f"`{c}` {rank.schema[c].dataType.simpleString()}" for c in slots)
    return rank.mapInArrow(place, f"{schema}, sequence_id long, offset long").select(*pieces.columns, "sequence_id", "offset")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` ids as best-fit decreasing finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids with ``with_ids``). Sequences are filled from offset 0 without gaps; ties
    between pieces of one length go by doc_id, piece, start and content. Repeated rows and null
    texts are pieces like others. A very long text is encoded whole (its ids take four bytes each);
    ids are cast to long. An empty table gives an empty result; other columns are ignored.
    """
    pieces = materialise(tokenize_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return assign_slots(pieces, capacity)
