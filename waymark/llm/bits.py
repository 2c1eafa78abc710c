"""Bit predictors over hashed contexts, mixed by gated logistic weights that are learnt online.

Every predictor holds counts of zeros and ones in a hashed table. The log odds of
all predictors are added with weights; how much two of the predictors have seen,
and the kind of the decision, pick the set of weights. A map from (kind, mixed log
odds) to what really happened refines the result.

A ``Learner`` goes through its decisions once: each lot is predicted from what came
before, moves the weights, and only then enters the counts. Learners of many tasks
are merged: counts and the refining map by sums, weights by an average over the
decisions that each saw. The merged ``Mixer`` is frozen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Counts of a row, and rows that go to the JVM at a time.
BLOCK, ROWS = 1 << 15, 32
_STATE = -1
_CURVE = np.linspace(-12, 12, 49)
_RATE = 0.15


@dataclass(frozen=True)
class Shape:
    """Predictors' table sizes (powers of two) and priors, kinds of decisions, and the two predictors that gate."""

    bits: tuple[int, ...]
    prior: tuple[float, ...]
    kinds: int
    gate_by: tuple[int, int]

    @property
    def starts(self) -> list[int]:
        return [sum(1 << b for b in self.bits[:p]) for p in range(len(self.bits) + 1)]

    @property
    def gates(self) -> int:
        return 25 * self.kinds


def slot_bits(events: int, least: int, most: int) -> int:
    """A table's size for so many events: it grows with the corpus up to the memory that ``most`` allows."""
    return min(most, max(least, int(max(1, events)).bit_length()))


def _level(seen: np.ndarray) -> np.ndarray:
    """How much a context has seen, in five levels."""
    return (seen > 0).view(np.int8) + (seen > 2).view(np.int8) + (seen > 7).view(np.int8) + (seen > 63).view(np.int8)


def _squash(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


def _mixed(weights: np.ndarray, gate: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
    """Weighted sum of the predictors' log odds; the last column of the weights is a constant."""
    total = weights[:, -1].take(gate, mode="clip")
    for p, s in enumerate(odds):
        part = weights[:, p].take(gate, mode="clip")
        part *= s
        total += part
    return np.clip(total, -12, 11.999, out=total)


class Learner:
    """Counts, weights and refining map of one task."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.counts = np.zeros(2 * shape.starts[-1], np.uint32)
        #: Both counts of a slot in one value, ones above zeros.
        self.pairs = self.counts.view("<u8")
        self.weights = np.full((shape.gates, len(shape.bits) + 1), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.square = np.full(self.weights.shape, 1e-2)
        self.hits = np.zeros(shape.gates)
        self.sums, self.seen = np.zeros((shape.kinds, len(_CURVE))), np.zeros((shape.kinds, len(_CURVE)))

    def step(self, slots: list[np.ndarray], kind: np.ndarray, bits: np.ndarray) -> None:
        """One lot of decisions: ``slots`` per predictor, each one's kind, and the bits that came."""
        if not len(bits):
            return
        shape, odds, level = self.shape, [], {}
        places = [slot.astype(np.int64) + start for slot, start in zip(slots, shape.starts, strict=False)]
        for p, place in enumerate(places):
            both = self.pairs.take(place, mode="clip").view("<u4")
            zeros, ones = both[::2].astype(np.float32), both[1::2].astype(np.float32)
            if p in shape.gate_by:
                level[p] = _level(zeros + ones)
            a = np.float32(shape.prior[p])
            zeros += a
            ones += a
            ones /= zeros
            odds.append(np.log(ones, out=ones))
        gate = (kind * 25 + level[shape.gate_by[0]] * 5 + level[shape.gate_by[1]]).astype(np.int64)
        mixed = _mixed(self.weights, gate, odds)
        error = bits - _squash(mixed)
        hit = np.bincount(gate, minlength=shape.gates)
        share = 1 / np.maximum(hit, 1)
        for p, s in enumerate([*odds, np.float32(1)]):
            grad = np.bincount(gate, (error * s).astype(np.float64), shape.gates) * share
            self.square[:, p] += grad * grad
            self.weights[:, p] += _RATE * grad / np.sqrt(self.square[:, p])
        self.hits += hit
        column = (kind * len(_CURVE) + ((mixed + 12.25) * 2).astype(np.int32)).astype(np.int64)
        self.sums += np.bincount(column, bits, self.sums.size).reshape(self.sums.shape)
        self.seen += np.bincount(column, minlength=self.seen.size).reshape(self.seen.shape)
        # an array of the table's own type keeps ufunc.at on its fast path
        came = np.where(bits > 0, np.uint64(1 << 32), np.uint64(1))
        for place in places:
            np.add.at(self.pairs, place, came)

    def rows(self) -> pa.RecordBatch:
        """The learner as rows (block, data): compressed counts, and one row of everything else."""
        return pa.Table.from_batches(list(self.batches())).combine_chunks().to_batches()[0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The same rows, a few at a time."""
        blocks, data = [_STATE], [np.concatenate([(self.weights * self.hits[:, None]).ravel(), self.hits, self.sums.ravel(), self.seen.ravel()]).tobytes()]
        for block in range(-(-len(self.counts) // BLOCK)):
            part = self.counts[block * BLOCK : (block + 1) * BLOCK]
            if part.any():
                blocks.append(block)
                data.append(_squeeze(part))
            if len(blocks) == ROWS:
                yield _batch(blocks, data)
                blocks, data = [], []
        if blocks:
            yield _batch(blocks, data)


def _batch(blocks: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _stretch(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts as 8 log2(n + 1) in a byte."""
    return np.minimum(255, np.round(8 * np.log2(counts + 1.0))).astype(np.uint8)


_COUNT = (2 ** (np.arange(256) / 8) - 1).astype(np.float64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their blocks, one running sum at a time."""
    now, total = None, None

    def done() -> pa.RecordBatch:
        data = total.tobytes() if now == _STATE else _code(total).tobytes()
        return _batch([now], [data])

    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = data.as_py()
            part = np.frombuffer(raw, np.float64) if block == _STATE else _stretch(raw).astype(np.int64)
            if block == now:
                total = total + part
            else:
                if now is not None:
                    yield done()
                now, total = block, part
    if now is not None:
        yield done()


def merged(rows: DataFrame, shape: Shape) -> Mixer:
    """The mixer of all learners' rows. Its size is the tables', whatever the corpus."""
    summed = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block int, data binary")
    counts = np.zeros(2 * shape.starts[-1], np.uint8)
    state = None
    for row in summed.toLocalIterator():
        if row["block"] == _STATE:
            state = np.frombuffer(bytes(row["data"]), np.float64)
        else:
            part = np.frombuffer(bytes(row["data"]), np.uint8)
            counts[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return Mixer(shape, counts, state)


class Mixer:
    """Frozen counts, weights and refining map."""

    def __init__(self, shape: Shape, counts: np.ndarray, state: np.ndarray | None):
        self.shape = shape
        #: Both counts' codes of a slot side by side.
        self.codes = counts.view("<u2")
        untaught = Learner(Shape((0,) * len(shape.bits), shape.prior, shape.kinds, shape.gate_by))
        weights, centre = untaught.weights, _squash(_CURVE)
        self.weights, refined = weights.copy(), np.tile(centre, (shape.kinds, 1))
        if state is not None:
            cuts = np.cumsum([weights.size, shape.gates, shape.kinds * len(_CURVE)])
            total, hits, sums, seen = np.split(state, cuts)
            taught = hits > 0
            self.weights[taught] = (total.reshape(weights.shape)[taught] / hits[taught, None]).astype(np.float32)
            refined = (sums.reshape(refined.shape) + 20 * centre) / (seen.reshape(refined.shape) + 20)
        refined = np.clip(refined, 1e-7, 1 - 1e-7)
        self.refine = np.log(refined / (1 - refined)).astype(np.float32).ravel()
        code = np.arange(1 << 16)
        zeros, ones = _COUNT[code & 255], _COUNT[code >> 8]
        self._odds = [np.log((ones + a) / (zeros + a)).astype(np.float32) for a in shape.prior]
        self._levels = _level(np.round(zeros + ones))

    def cost(self, slots: list[np.ndarray], kind: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Each decision's cost: minus the natural logarithm of the probability of the bit that came."""
        shape, odds, level = self.shape, [], {}
        for p, (slot, start) in enumerate(zip(slots, shape.starts, strict=False)):
            code = self.codes.take(slot.astype(np.int64) + start, mode="clip").astype(np.int64)
            if p in shape.gate_by:
                level[p] = self._levels.take(code, mode="clip")
            odds.append(self._odds[p].take(code, mode="clip"))
        mixed = _mixed(self.weights, (kind * 25 + level[shape.gate_by[0]] * 5 + level[shape.gate_by[1]]).astype(np.int64), odds)
        column = (mixed + 12) * 2
        low = column.astype(np.int32)
        share = column - low.astype(np.float32)
        at = (kind * len(_CURVE) + low).astype(np.int64)
        curve = self.refine.take(at, mode="clip") * (1 - share) + self.refine.take(at + 1, mode="clip") * share
        final = 0.5 * (mixed + curve)
        return np.log1p(np.exp(np.where(bits > 0, -final, final)))
