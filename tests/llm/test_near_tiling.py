"""Near-duplicates and string tiling against brute force."""

import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from waymark.llm import catalog, decontaminate
from waymark.llm.decontaminate import _near_seeds, drop_contaminated, overlaps, tile
from waymark.llm.near import dart_signatures, keep_one_of_each, near_duplicates, weighted
from waymark.llm.words import mix, windows


def shingle_set(text, n=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def brute_classes(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                common, total = sum((sets[a] & sets[b]).values()), sum(sets[a].values()) + sum(sets[b].values())
                if total == 0 or common / (total - common) >= 0.8:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def family():
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs, passage = [], fresh(60)
    for _ in range(12):
        base = fresh(rng.randrange(60, 300))
        for _ in range(rng.randrange(1, 6)):
            copy = base[:]
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            docs.append(copy)
    docs += [fresh(60) + passage + fresh(60) for _ in range(25)]
    hot = fresh(200)
    docs += [[*hot[:i], "x", *hot[i:]] for i in range(60)]
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def test_classes(spark, family):
    got = near_duplicates(spark.createDataFrame(family, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(family)


def test_edges(odd, none):
    got = [(r.doc_id, r.class_id) for r in near_duplicates(odd).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (5, 5), (6, 1), (7, 7), (8, 7), (None, None), (9, 9), (10, 5)]))
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 5, 7, 9, None]))
    assert near_duplicates(none).count() == 0


def edited(rng, words, changes, tag):
    copy = words[:]
    for i in rng.sample(range(len(words)), changes):
        copy[i] = f"{tag}x{i}"
    return copy


def test_edits_of_one_original_are_one_class(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    docs = [(i, edited(rng, base, 7, i)) for i in range(2000)] + [(2000, base)]
    whole = shingle_set(" ".join(base))
    assert all(2 * sum((whole & (s := shingle_set(" ".join(w)))).values()) >= 8 / 9 * (sum(whole.values()) + sum(s.values())) for _, w in docs)
    got = near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"))
    assert {r.class_id for r in got.collect()} == {0}


def test_large_buckets_are_finished(spark, monkeypatch):
    rng = random.Random(7)
    template = [f"w{i}" for i in range(200)]
    docs = []
    for f in range(12):
        base = edited(rng, template, 4, f"f{f}")
        docs += [edited(rng, base, rng.randrange(0, 4), f"d{f}n{i}") for i in range(6)]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    df, expected = spark.createDataFrame(docs, "doc_id long, text string"), brute_classes(docs)
    monkeypatch.setattr("waymark.llm.near.HUBS", 1)
    monkeypatch.setattr("waymark.llm.near.SMALL_BUCKET", 4)
    monkeypatch.setattr("waymark.llm.near.BLOCK_TEXTS", 20)
    assert 1 < len(set(expected.values())) and {r.doc_id: r.class_id for r in near_duplicates(df, bands=64, rows=3).collect()} == expected


def brute_tiles(item, doc, m):
    item, doc, total = list(item), list(doc), 0
    while True:
        best = (0, 0, 0)
        for b in range(len(doc)):
            for a in range(len(item)):
                k = 0
                while a + k < len(item) and b + k < len(doc) and item[a + k] == doc[b + k] and item[a + k] is not None:
                    k += 1
                if k > best[0]:
                    best = (k, a, b)
        if best[0] < m:
            return total
        k, a, b = best
        item[a : a + k], doc[b : b + k] = [None] * k, [object() for _ in range(k)]
        total += k


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item, doc = rng.integers(0, 4, 25), rng.integers(0, 4, 60)
        hashes = lambda x: mix(x.astype(np.uint64) + np.uint64(7))
        for words in (hashes(doc), _near_seeds(hashes(item), hashes(doc), 3)):
            tiles = tile(hashes(item), words, 3)
            assert sum(t[2] for t in tiles) == brute_tiles(item.tolist(), doc.tolist(), 3)
            assert all((hashes(item)[a : a + n] == words[b : b + n]).all() for a, b, n in tiles)


def test_repetitive_texts_are_cheap():
    item, doc = np.full(2000, 7, np.uint64), np.full(20_000, 7, np.uint64)
    began = time.monotonic()
    tracemalloc.start()
    assert tile(item, doc, 5) == [(0, 0, 2000)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.monotonic() - began < 2 and most < 30e6
    two = np.tile(np.arange(2, dtype=np.uint64), 1000)
    assert sum(t[2] for t in tile(two, np.tile(two, 5)[::-1].copy(), 5)) == 2000


def test_overlaps(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(40))
    halves = " ".join(item.split()[20:] + ["gap"] + item.split()[:20])
    docs = [(1, "before " + item + " after"), (2, halves), (3, "q1 q2 q3 q4 q5 q6 other words"), (4, None), (5, ("a b " * 3000) + item.upper()), (1, item)]
    bench = [(7, item), (8, "too short"), (9, None), (10, "zz " * 30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    rows = overlaps(d, b).collect()
    assert sorted((r.doc_id, r.item_id, r.matched_words) for r in rows) == [(1, 7, 40), (1, 7, 40), (2, 7, 40), (5, 7, 40)]
    assert sorted(r.doc_id for r in drop_contaminated(d, b).collect()) == [3, 4]
    assert overlaps(d, b.limit(0)).count() == overlaps(none, b).count() == overlaps(odd, b).count() == 0


def test_null_string_and_repeated_item_ids(spark):
    item = " ".join(f"q{i}" for i in range(40))
    docs = spark.createDataFrame([("a", item), (None, item), ("c", "no such words here at all")], "doc_id string, text string")
    bench = spark.createDataFrame([(None, item, 1), (-1, item, 2), (-1, item, 3)], "item_id long, text string, t1 long")
    rows = overlaps(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == {("a", None): 1, (None, None): 1, ("a", -1): 2, (None, -1): 2}
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, bench).collect()) == ["None", "c"]


@pytest.mark.parametrize("cut", [64, 2 << 20])
def test_overlaps_equal_brute_force(spark, monkeypatch, cut):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(9)}"
    bench = [(i, " ".join(word() for _ in range(rng.randrange(4, 25)))) for i in range(12)]
    docs = []
    for i in range(40):
        words = [word() for _ in range(30)]
        parts = rng.choice(bench)[1].split()
        half = rng.randrange(len(parts))
        docs.append((i, " ".join(words + parts[half:] + words[:3] + parts[:half])))
    monkeypatch.setattr(decontaminate, "windows", lambda texts: windows(texts, cut))
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), min_match=3).collect()
    want = {}
    for d, text in docs:
        for k, item in bench:
            n = brute_tiles(item.split(), text.split(), 3)
            if n >= 0.5 * len(item.split()):
                want[d, k] = n
    assert {(r.doc_id, r.item_id): r.matched_words for r in got} == want and len(want) > 20


def test_coordinates_agree_like_the_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = mix(np.arange(1, 41, dtype=np.uint64))
    for _ in range(6):
        a, b = np.exp(rng.normal(0, 1.5, 40)), np.exp(rng.normal(0, 1.5, 40))
        b[:20] = a[:20]
        k = 4096
        ids = dart_signatures(np.tile(elements, 2), np.concatenate([a, b]), np.array([0, 40, 80]), k)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((ids[0] == ids[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5
    found, counts, bounds = weighted(np.array([7, 5, 7, 7, 7, 2], np.uint64), np.array([0, 4, 4, 6]))
    assert (found.tolist(), counts.tolist(), bounds.tolist()) == ([5, 7, 2, 7], [1, 3, 1, 1], [0, 2, 2, 4])


def test_a_template_hides_no_link(spark):
    rng = random.Random(9)
    template = [f"t{i}" for i in range(304)]
    docs = []
    for i in range(300):
        own = [f"o{i}x{j}" for j in range(52)]
        one, other = template + own, template + own
        other = other[:]
        for j in rng.sample(range(304, 356), 2):
            other[j] = f"c{i}x{j}"
        docs += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
    sets = {i: shingle_set(t) for i, t in docs}
    similar = lambda a, b: (c := sum((sets[a] & sets[b]).values())) / (sum(sets[a].values()) + sum(sets[b].values()) - c)
    assert all(similar(2 * i, 2 * i + 1) >= 0.8 for i in range(300)) and max(similar(0, j) for j in range(2, 600)) < 0.8
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * i + 1] == got[2 * i] == 2 * i for i in range(300))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_all_pairs(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in catalog.op3_dart_minhash(spark, f"/root/testdata/{folder}").collect()}
    assert got == brute_classes(docs)
