"""Near-duplicates by DartMinHash signatures of weighted word shingles.

A text is the multiset of its five-word shingles, a weighted set (weights may be any
positive numbers). Each shingle's weight axis is cut into regions that double in
width, into which darts fall by a Poisson process that depends on the region alone; a text
sees the darts below its weight whose rank is under a cut-off that makes about
k ln k of them. Each dart belongs to one of k coordinates, and a coordinate keeps
its earliest dart. Two texts agree on a coordinate with a probability equal to
their weighted Jaccard similarity.

Coordinates are joined in bands; texts in one bucket are compared with hubs of the
bucket first, and with each other only where that leaves them in different classes.
In the end every pair of a bucket is verified on the whole texts' multisets, joined
by verified links, or ruled out by its shingle counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import lookup_join, materialise, small_batches, text_or_empty, without_ids
from waymark.llm.words import mix, shingles, slices, split_words, without_nulls
from waymark.operators.components import connected_components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Buckets up to this size have their remaining pairs compared at once; larger ones get more hubs first.
SMALL_BUCKET, HUBS = 16, 8
#: Members and shingles of a block of a large bucket; blocks are compared two by two.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 200_000
#: Members of a hub that are verified together; a hub with more is dealt out again with its text.
HUB_SHARE = 32
TEXTS_AT_ONCE = 256


def weighted(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct elements, their counts, and the ranges of texts in them."""
    ordered = hashes.copy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        ordered[a:b].sort()
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(fresh)
    return ordered[at], np.diff(np.append(at, len(ordered))).astype(np.float64), np.searchsorted(at, bounds)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """(texts, k) dart ids: each coordinate's earliest dart; a text without weight has zeros.

    Text i has the elements from ``bounds[i]`` up to ``bounds[i + 1]``, each once, with
    positive real weights. The number of darts per text is about k ln k however
    many elements it has and whatever they weigh, so memory is bounded by the texts handled at a time.
    """
    parts = [np.zeros((0, k), np.uint64)]
    for a in range(0, len(bounds) - 1, TEXTS_AT_ONCE):
        own = bounds[a : a + TEXTS_AT_ONCE + 1]
        parts.append(_signatures(elements[own[0] : own[-1]], weights[own[0] : own[-1]], own - own[0], k))
    return np.concatenate(parts)


def _regions(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """The weight axis of each element in regions [0, 1), [1, 2), [2, 4), [4, 8), ..., as far as its weight reaches.

    Gives each region's id, start, width, the element's weight, and the text. A region's
    darts are the same in every text, so texts that weigh an element differently
    share those below the lesser weight.
    """
    levels = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    return mix(elements[at] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.where(level > 0, width, 0), width, weights[at], owner[at]


def _uniform(drop: np.ndarray) -> np.ndarray:
    return ((drop >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    texts = len(bounds) - 1
    ids = np.zeros(texts * k, np.uint64)
    whose = np.repeat(np.arange(texts), np.diff(bounds))
    total = np.bincount(whose, weights, texts)
    region, start, width, weight, owner = _regions(elements, weights, whose)
    # nearly all regions are of width 1 and lie below their element's weight, so that all their darts are the element's
    simple = (width == 1) & (start + width <= weight)
    todo = np.flatnonzero(total)
    darts = k * math.log(k) + 4 * k
    while len(todo):
        cuts = (darts / np.maximum(total, 1e-300))[owner]
        best = np.full(texts * k, np.inf)
        thrown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        again = np.isin(owner, todo) if len(todo) < texts else np.ones(len(owner), bool)
        for mine in (again & simple, again & ~simple):
            held = [region[mine], np.zeros(int(mine.sum())), cuts[mine], owner[mine]]
            held += [] if simple[mine].all() else [start[mine], width[mine], weight[mine]]
            turn = np.uint64(0)
            while len(held[0]):
                turn += np.uint64(1)
                drop = mix(held[0] + np.array([0xD1B54A32D192ED03], np.uint64) * turn)
                gap = np.log(_uniform(drop))
                held[1] = held[1] - (gap / held[5] if len(held) > 4 else gap)
                seen = held[1] < held[2]
                held, drop = [x[seen] for x in held], drop[seen]
                dart = mix(drop ^ np.uint64(0xA0761D6478BD642F))
                place, rank = held[3] * k + (dart % np.uint64(k)).astype(np.int64), held[1]
                if len(held) > 4:
                    own = held[4] + held[5] * _uniform(mix(dart)) < held[6]
                    place, rank, dart = place[own], rank[own], dart[own]
                np.minimum.at(best, place, rank)
                thrown.append((place, rank, dart))
        place, rank, dart = (np.concatenate(c) for c in zip(*thrown, strict=True))
        first = rank == best[place]
        ids[place[first]] = dart[first]
        filled = np.isfinite(best.reshape(texts, k)[todo]).all(axis=1)
        todo, darts = todo[~filled], 2 * darts
    return ids.reshape(texts, k)


def band_hashes(ids: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(ids), bands)).copy()
    split = ids.reshape(len(ids), bands, rows)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + split[:, :, r])
    return out.view(np.int64)


_SKETCH = "id long, hi long, lo long, n long, bands array<long>"


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, a 128-bit key of the text's word sequence, its shingle count, and the band hashes (none for no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = without_nulls(batch.column(1))
            for at, to in slices(texts):
                words = split_words(texts, at, to)
                parts, bounds = shingles(words, size)
                hashes = band_hashes(dart_signatures(*weighted(parts, bounds), bands * rows), bands, rows)
                keys = np.frombuffer(
                    b"".join(
                        hashlib.blake2b(words.hashes[a:b], digest_size=16).digest()
                        for a, b in zip(words.first[:-1], words.first[1:], strict=True)
                    ),
                    np.int64,
                ).reshape(-1, 2)
                counts = np.diff(bounds)
                kept = counts > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(kept * bands)]), pa.int32()), pa.array(hashes[kept].ravel())
                )
                columns = [batch.column(0).slice(at, to - at), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(counts), lists]
                yield pa.record_batch(columns, names=["id", "hi", "lo", "n", "bands"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, _SKETCH)


def _multiset(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of the counts; 1 for two empty multisets."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    at = np.searchsorted(a[0], b[0])
    hit = at < len(a[0])
    hit[hit] = a[0][at[hit]] == b[0][hit]
    common = int(np.minimum(a[1][at[hit]], b[1][hit]).sum())
    return common / (total - common)


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, least: float) -> DataFrame:
    """Of stored pairs (hub, id), those whose whole texts have at least ``least`` similarity.

    Pairs of one hub are dealt out in shares of ``HUB_SHARE``; each share streams
    through one task behind a copy of the hub's text, which is all a task holds.
    """
    ids = pairs.select("id").unionByName(pairs.select(F.col("hub").alias("id"))).distinct()
    ids = materialise(ids, "ids")
    named = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    texts = materialise(lookup_join(named, ids, ["id"], "left_semi"), "texts")
    crowded = materialise(
        pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_SHARE).select("hub", F.ceil(F.col("n") / HUB_SHARE).alias("shares")),
        "crowded",
    )
    dealt = materialise(
        lookup_join(pairs, crowded, ["hub"], "left").select(
            "hub", "id", F.coalesce(F.pmod(F.xxhash64("id"), F.col("shares")), F.lit(0)).cast("long").alias("share")
        ),
        "dealt",
    )
    members = dealt.join(texts, "id").select("hub", "share", F.lit(1).alias("kind"), "id", "text")
    hubs = (
        dealt.select("hub", "share").distinct().join(texts.withColumnRenamed("id", "hub"), "hub")
        .select("hub", "share", F.lit(0).alias("kind"), F.col("hub").alias("id"), "text")
    )
    streamed = members.unionByName(hubs).repartition("hub", "share").sortWithinPartitions("hub", "share", "kind")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets = None, []
        for batch in batches:
            texts_ = without_nulls(batch.column(4))
            hub, share, kind, key = (batch.column(i).to_numpy() for i in range(4))
            linked: list[tuple[int, int]] = []
            for at, to in slices(texts_):
                parts, bounds = shingles(split_words(texts_, at, to), size)
                for i in range(at, to):
                    own = _multiset(parts[bounds[i - at] : bounds[i - at + 1]])
                    if kind[i] == 0:
                        if current != (hub[i], share[i]):
                            current, sets = (hub[i], share[i]), []
                        sets.append(own)
                    elif any(weighted_jaccard(s, own) >= least for s in sets):
                        linked.append((hub[i], key[i]))
            pairs_ = np.asarray(linked, np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(pairs_[:, 0]), pa.array(pairs_[:, 1])], names=["src", "dst"])

    return materialise(streamed.mapInArrow(check, "src long, dst long").distinct(), "links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: id, class_id (least id of its class), copies_of (least id with equal words).

    Classes are the connected components of verified links and of equal word
    sequences. A pair of exactly the least similarity shares a bucket with a
    probability of 1 - (1 - similarity ** rows) ** bands (over 0.9999 by default).
    Texts without words, null ones included, are one class. Rows repeated under one
    id are one document, as are different texts under one id (their links add up).
    Rows with a null id keep a null class. An empty table gives an empty result. A text is
    held whole, with arrays some thirty times its bytes; ids are cast to long.
    """
    sketches = materialise(sketch(docs, id_col, text_col, shingle_words, bands, rows), "sketches")
    known = sketches.where("id is not null")
    copies = materialise(
        known.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "copies"
    )
    named = materialise(
        lookup_join(known, copies, ["hi", "lo"], "left").select("id", F.coalesce("rep", "id").alias("rep"), "n", "bands"), "named"
    )
    banded = named.where("id = rep").select("rep", "n", F.explode("bands").alias("band")).distinct()
    banded = materialise(banded, "banded")
    buckets = materialise(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    in_buckets = materialise(lookup_join(banded, buckets, ["band"], "inner"), "in_buckets")
    meets = materialise(in_buckets.groupBy("rep").agg(F.sum("m").alias("meets")), "meets")
    in_buckets = materialise(lookup_join(in_buckets, meets, ["rep"], "inner"), "in_buckets")
    hubs = materialise(in_buckets.groupBy("band").agg(F.max(F.struct("meets", "rep", "n")).alias("hub")), "hubs")
    sized = lookup_join(in_buckets, hubs, ["band"], "inner").where(_close(F.col("n"), F.col("hub.n"), similarity) & (F.col("rep") != F.col("hub.rep")))
    first = sized.groupBy("rep").agg(F.max("hub").alias("hub")).select(F.col("hub.rep").alias("hub"), F.col("rep").alias("id"))
    first = materialise(first, "pairs")
    links = verify(first, docs, id_col, text_col, shingle_words, similarity)
    parts = materialise(connected_components(links), "parts")
    rest = materialise(_unsettled(in_buckets, parts, similarity).join(first, ["hub", "id"], "left_anti"), "rest")
    if rest.take(1):
        links = links.unionByName(verify(rest, docs, id_col, text_col, shingle_words, similarity))
        parts = materialise(connected_components(links), "parts")
    still = materialise(_open_members(in_buckets.where(F.col("m") > SMALL_BUCKET), parts), "still")
    if still.take(1):
        late = _compare_blocks(still, docs, id_col, text_col, shingle_words, similarity)
        if late.take(1):
            links = links.unionByName(late)
            parts = connected_components(links)
    equal = named.where("id <> rep").select("id", "rep").distinct()
    # ids under several texts tie their classes together
    torn = equal.join(named.where("id = rep").select("id").distinct(), "id", "left_semi")
    torn = torn.unionByName(equal.groupBy("id").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").select("id", "rep"))
    if torn.take(1):
        links = links.unionByName(equal.select(F.col("rep").alias("src"), F.col("id").alias("dst")))
        parts = connected_components(links)
    parts = materialise(parts, "classes")
    placed = materialise(
        lookup_join(named.select("id", "rep"), parts.select(F.col("node").alias("rep"), "component"), ["rep"], "left"), "placed"
    )
    settled = placed.select(
        F.col("id").alias(id_col), F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("copies_of")
    )
    nameless = sketches.where("id is null").select(
        F.col("id").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("copies_of")
    )
    return settled.unionByName(nameless)


def _close(a: Column, b: Column, similarity: float) -> Column:
    """Whether two shingle counts allow that similarity: their ratio bounds it from above."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def _open_members(in_buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (band, m, rep, n, meets, part) of the buckets whose members are in different parts."""
    known = lookup_join(in_buckets, parts.select(F.col("node").alias("rep"), "component"), ["rep"], "left")
    known = materialise(known.select("rep", "n", "band", "m", "meets", F.coalesce("component", "rep").alias("part")), "known")
    open_buckets = known.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band")
    return lookup_join(known, materialise(open_buckets, "open"), ["band"], "left_semi")


def _unsettled(in_buckets: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (hub, id) to compare next: members of one bucket that the first links left in different parts.

    Small buckets give all such pairs. In a large one, every member is compared with
    ``HUBS`` more hubs wherever the parts differ: of each of as many shares by hash,
    the member that meets most others in all its buckets, as the original of a family does.
    """
    members = materialise(_open_members(in_buckets, parts), "members")
    few = materialise(members.where(F.col("m") <= SMALL_BUCKET).select("band", "rep", "n", "part"), "few")
    other = few.select(F.col("rep").alias("id"), F.col("n").alias("n2"), F.col("part").alias("part2"), "band")
    matched = few.join(other, "band").where(F.expr("rep < id and part <> part2") & _close(F.col("n"), F.col("n2"), similarity))
    pairs = matched.select(F.col("rep").alias("hub"), "id")
    large = members.where(F.col("m") > SMALL_BUCKET)
    share = F.pmod(F.xxhash64("rep", "band"), F.lit(HUBS))
    drawn = [F.max_by(F.struct("rep", "n", "part"), F.when(share == k, F.struct("meets", "rep"))) for k in range(HUBS)]
    hubs = materialise(large.groupBy("band").agg(F.array_compact(F.array(*drawn)).alias("hubs")), "hubs")
    fitting = F.filter("hubs", lambda h: (h["part"] != F.col("part")) & _close(F.col("n"), h["n"], similarity))
    met = lookup_join(large, hubs, ["band"], "inner").select("rep", F.explode(F.array_distinct(fitting)).alias("h"))
    stars = met.select(F.col("h.rep").alias("hub"), F.col("rep").alias("id"))
    return pairs.unionByName(stars).distinct()


def _compare_blocks(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, least: float) -> DataFrame:
    """Links (src, dst) among the members of open large buckets, after every pair of a bucket was settled.

    A bucket is dealt into blocks, and each two blocks meet in one task. A pair is
    passed over if verified links join it already or if its shingle counts are too far
    apart, and left to the least bucket that holds both.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    counted = materialise(members.groupBy("band").agg(blocks.cast("long").alias("blocks")), "blocks")
    within = materialise(members.groupBy("rep").agg(F.collect_set("band").alias("within")), "within")
    named = docs.select(F.col(id_col).cast("long").alias("rep"), text_or_empty(text_col).alias("text"))
    texts = materialise(lookup_join(named, within.select("rep"), ["rep"], "left_semi").distinct().join(within, "rep"), "block_texts")
    placed = lookup_join(members.select("band", "rep", "part").distinct(), counted, ["band"], "inner")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = materialise(met.select("band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "part"), "met")

    def compare(group: pa.Table) -> pa.Table:
        texts_ = without_nulls(group.column("text").combine_chunks())
        if isinstance(texts_, pa.ChunkedArray):
            texts_ = pa.concat_arrays(texts_.chunks)
        sets = []
        for at, to in slices(texts_):
            parts, bounds = shingles(split_words(texts_, at, to), size)
            sets += [_multiset(parts[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        counts = [int(s[1].sum()) for s in sets]
        band, rep, own, part = group.column("band")[0].as_py(), *(group.column(c).to_pylist() for c in ("rep", "own", "part"))
        crossed = group.column("a")[0] != group.column("b")[0]
        within_ = [set(x) for x in group.column("within").to_pylist()]
        parent = {p: p for p in part}

        def root(p: int) -> int:
            while parent[p] != p:
                parent[p] = p = parent[parent[p]]
            return p

        order = sorted(range(len(sets)), key=counts.__getitem__)
        linked: list[tuple[int, int]] = []
        for k, x in enumerate(order):
            for y in order[k + 1 :]:
                if counts[x] < least * counts[y]:
                    break
                if (crossed and own[x] == own[y]) or root(part[x]) == root(part[y]) or min(within_[x] & within_[y]) != band:
                    continue
                if weighted_jaccard(sets[x], sets[y]) >= least:
                    linked.append((rep[x], rep[y]))
                    parent[root(part[x])] = root(part[y])
        pairs = np.asarray(linked, np.int64).reshape(-1, 2)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return materialise(met.join(texts, "rep").groupBy("band", "a", "b").applyInArrow(compare, "src long, dst long").distinct(), "late")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` with only the least id of each class; all columns stay, and rows with a null id too."""
    classes = near_duplicates(docs, id_col, text_col, **parameters)
    dropped = classes.where(F.col(id_col) != F.col("class_id")).select(id_col).distinct()
    return without_ids(docs, id_col, materialise(dropped, "dropped"))
