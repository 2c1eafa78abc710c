"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the beginnings of its words
(for inflected or compounded forms). The model adds a weight per term and, for
each pair of terms present, the product of their factors, so that two terms that
mean harm only together are learnt as a pair.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.store import lookup_join, materialise, small_batches, text_or_empty, without_ids
from waymark.llm.words import Words, mix, slices, split_words, without_nulls

PREFIXES = (4, 5)
#: Terms are 31-bit hashes; while they are counted, so many leading bits tell them apart.
TERM_BITS, COUNT_BITS = 31, 21
#: Bounds of the training sample: labelled rows, those with the smallest hash of their id, and all their terms.
SAMPLE_ROWS, SAMPLE_TERMS = 20_000, 40_000_000
FEATURES, FACTORS, EPOCHS = 4096, 8, 40


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashed terms, and the ranges of texts in them."""
    owner = words.owner().astype(np.uint64)
    values, owners = [words.hashes], [owner]
    for k, found in words.prefixes.items():
        has = found != 0
        values.append(mix(found[has] + np.uint64(0x51ED * k)))
        owners.append(owner[has])
    term = np.concatenate(values) >> np.uint64(64 - TERM_BITS)
    keyed = np.unique((np.concatenate(owners) << np.uint64(32)) | term)
    bounds = np.searchsorted(keyed, np.arange(len(words.first), dtype=np.uint64) << np.uint64(32))
    return (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64), bounds


@dataclass
class Model:
    bias: float
    slot: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One logit per text; ``found`` holds terms, of which only the model's count."""
        texts = len(bounds) - 1
        at, hit = _place(self.slot, found)
        owner = np.repeat(np.arange(texts), np.diff(bounds))[hit]
        return _logits(at[hit], owner, texts, self.bias, self.weight, self.factor)[0]


def _sum(owner: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owner, values, texts)


def _sums(owner: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    """Sums of every column."""
    out = np.zeros((texts, values.shape[1]))
    for f in range(values.shape[1]):
        out[:, f] = _sum(owner, values[:, f], texts)
    return out


def _logits(feature, owner, texts, bias, weight, factor):
    linear = _sum(owner, weight[feature], texts)
    sums = _sums(owner, factor[feature], texts)
    squares = _sum(owner, (factor[feature] ** 2).sum(1), texts)
    return bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def _runs(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` terms, or one row of more."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1))
        yield at, to
        at = to


def _place(slot: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms are among the sorted ``slot``, and whether they are."""
    at = np.searchsorted(slot, found)
    hit = at < len(slot)
    hit[hit] = slot[at[hit]] == found[hit]
    return at, hit


def _chi(size: np.ndarray, here: np.ndarray, n: int, positive: float) -> np.ndarray:
    """Chi-square of presence against the label; terms in fewer than three texts have none."""
    expected = size * (positive / n)
    variance = expected * (1 - positive / n) * (1 - size / n)
    return np.where(size >= 3, (here - expected) ** 2 / np.maximum(variance, 1e-9), -1)


def _choose(flat: np.ndarray, bounds: np.ndarray, labels: np.ndarray, features: int) -> np.ndarray:
    """The terms with the largest chi-square, sorted: first counted by their leading bits, then the best of those one by one."""
    n, positive = len(labels), float(labels.sum())
    shift = TERM_BITS - COUNT_BITS
    size, here = np.zeros(1 << COUNT_BITS, np.int64), np.zeros(1 << COUNT_BITS, np.int64)
    for i, j in _runs(bounds):
        rough = flat[bounds[i] : bounds[j]] >> shift
        size += np.bincount(rough, minlength=1 << COUNT_BITS)
        bad = np.repeat(labels[i:j] == 1, np.diff(bounds[i : j + 1]))
        here += np.bincount(rough[bad], minlength=1 << COUNT_BITS)
    chi = _chi(size, here, n, positive)
    wanted = np.zeros(1 << COUNT_BITS, bool)
    wanted[np.argsort(-chi, kind="stable")[: 2 * features]] = True
    wanted &= chi >= 0
    kept, of_bad = [np.zeros(0, flat.dtype)], [np.zeros(0, bool)]
    for i, j in _runs(bounds):
        part = flat[bounds[i] : bounds[j]]
        mine = wanted[part >> shift]
        kept.append(part[mine])
        of_bad.append(np.repeat(labels[i:j] == 1, np.diff(bounds[i : j + 1]))[mine])
    whole, bad = np.concatenate(kept), np.concatenate(of_bad)
    term, size = np.unique(whole, return_counts=True)
    here = np.bincount(np.searchsorted(term, whole[bad]), minlength=len(term))
    chi = _chi(size, here, n, positive)
    order = np.argsort(-chi, kind="stable")[:features]
    return np.sort(term[order[chi[order] >= 0]])


def fit(
    flat: np.ndarray, bounds: np.ndarray, labels: np.ndarray, features: int = FEATURES, factors: int = FACTORS, epochs: int = EPOCHS
) -> Model:
    """Terms chosen by chi-square of presence against the label, then Adam on the logistic loss.

    ``flat`` holds all rows' terms, row i those from ``bounds[i]`` up to ``bounds[i + 1]``.
    Without rows of both labels the model is the constant base rate.
    """
    n, positive = len(labels), float(labels.sum())
    rate = (positive + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    none = np.zeros(0)
    if not 0 < positive < n:
        return Model(bias, none.astype(np.int64), none, np.zeros((0, factors)))
    slot = _choose(flat, bounds, labels, features)
    parts = []
    for i, j in _runs(bounds):
        at, hit = _place(slot, flat[bounds[i] : bounds[j]])
        parts.append((at[hit].astype(np.int32), np.bincount(np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))[hit], minlength=j - i)))
    feature = np.concatenate([p for p, _ in parts])
    start = np.concatenate([[0], np.cumsum(np.concatenate([k for _, k in parts]))])
    random = np.random.default_rng(17)
    params = [np.zeros(1), np.zeros(len(slot)), random.normal(0, 0.02, (len(slot), factors))]
    params[0][:] = bias
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    batch = 2048
    for epoch in range(epochs):
        rate_now = 0.05 * 0.5 ** (epoch // 10)
        order = random.permutation(n)
        for chunk in (order[i : i + batch] for i in range(0, n, batch)):
            spans = [np.arange(start[i], start[i + 1]) for i in chunk]
            pick = np.concatenate(spans)
            own = np.repeat(np.arange(len(chunk)), [len(s) for s in spans])
            fea = feature[pick]
            logit, sums = _logits(fea, own, len(chunk), params[0][0], params[1], params[2])
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chunk]) / len(chunk)
            grads = [np.array([error.sum()]), _sum(fea, error[own], len(slot)) + 1e-5 * params[1]]
            pair = (sums[own] - params[2][fea]) * error[own, None]
            grads.append(_sums(fea, pair, len(slot)) + 1e-4 * params[2])
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                params[j] -= rate_now * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    return Model(float(params[0][0]), slot, params[1], params[2])


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held_out_fold: int = 0,
    sample_rows: int = SAMPLE_ROWS,
    sample_terms: int = SAMPLE_TERMS,
) -> Model:
    """Fit on at most ``sample_rows`` labelled rows whose fold isn't held out, with at most ``sample_terms`` distinct terms in all.

    Null labels and ids are no examples; an id with several labels counts as the
    larger, one with several texts as one of them. The sample is fitted in one task, whose
    memory those two bounds limit; only the model comes to the driver. A table
    without labels, or without documents, gives the constant base rate.
    """
    known = labels.select(F.col(id_col).alias("__wm_id"), F.col(label_col).cast("int").alias("__wm_y")).where(
        "__wm_id is not null and __wm_y is not null"
    )
    known = known.where(fold(F.col("__wm_id"), folds) != held_out_fold).groupBy("__wm_id").agg(F.max("__wm_y").alias("__wm_y"))
    sample = materialise(known.orderBy(F.xxhash64("__wm_id"), "__wm_id").limit(sample_rows), "sample")
    texts = docs.select(F.col(id_col).alias("__wm_id"), text_or_empty(text_col).alias("text"))
    rows = lookup_join(texts, sample, ["__wm_id"], "inner", limit=sample_rows).select("__wm_id", "__wm_y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = without_nulls(batch.column(2))
            for at, to in slices(texts_):
                found, bounds = terms(split_words(texts_, at, to, PREFIXES))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
                yield pa.record_batch([*(batch.column(i).slice(at, to - at) for i in (0, 1)), lists], names=["__wm_id", "y", "terms"])

    small_batches(docs.sparkSession)
    kind = rows.schema["__wm_id"].dataType.simpleString()
    got = rows.mapInArrow(extract, f"__wm_id {kind}, y int, terms array<int>").withColumn("h", F.xxhash64("terms"))
    got = materialise(got.groupBy("__wm_id").agg(F.min(F.struct("h", "y", "terms")).alias("r")).select("__wm_id", "r.y", "r.terms"), "terms")
    order = F.xxhash64("__wm_id")
    # a window over at most ``sample_rows`` narrow rows
    until = F.sum(F.size("terms")).over(Window.orderBy(order, "__wm_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = materialise(got.select("__wm_id", order.alias("o"), until.alias("until")).where(F.col("until") <= sample_terms).select("__wm_id", "o"), "within")
    bounded = lookup_join(got, within, ["__wm_id"], "inner", limit=sample_rows)

    def learn(table: pa.Table) -> pa.Table:
        at = np.argsort(table.column("o").to_numpy(), kind="stable")
        chosen = table.select(["y", "terms"]).take(pa.array(at)).combine_chunks()
        del table
        lists = chosen.column("terms").chunk(0)
        y = (chosen.column("y").to_numpy() > 0).astype(float)
        model = fit(lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), y)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    fitted = bounded.groupBy(F.lit(0).alias("one")).applyInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(fitted[0]["model"])) if fitted else fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score) per input row, over its whole text; null and empty texts get the model's base score.

    Repeated rows and null ids are rows like others; equal texts, and texts of the same terms,
    tie. A text is held whole, with arrays some twenty times its bytes. An empty table
    gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = without_nulls(batch.column(1))
            parts = [np.zeros(0)]
            for at, to in slices(texts):
                parts.append(model.logits(*terms(split_words(texts, at, to, PREFIXES))))
            logit = np.clip(np.concatenate(parts), -500, 500)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-logit)))], names=["id", "score"])

    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    small_batches(docs.sparkSession)
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents scored ``threshold`` or more; rows with a null id stay."""
    scores = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    rejected = scores.where(F.col("score") >= threshold).select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return without_ids(docs, id_col, materialise(rejected, "rejected"))
