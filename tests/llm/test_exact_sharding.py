"""Exact copies and shards: stated results, edge cases, hot groups."""

import random
import zlib
from collections import Counter, defaultdict

from waymark.llm import catalog
from waymark.llm.exact import drop_exact_copies, exact_groups
from waymark.llm.sharding import shard_documents


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return Counter((i, max((x for x in by[t or ""] if x is not None), default=None), len(by[t or ""])) for i, t in rows)


def test_groups(odd):
    for limit in (200_000, 0):
        rows = exact_groups(odd, broadcast_rows=limit).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == brute([(r.doc_id, r.text) for r in odd.collect()])
        assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_drop_keeps_columns_and_texts(odd, none):
    out = drop_exact_copies(odd)
    assert out.columns == odd.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert {t or "" for _, t in kept} == {r.text or "" for r in odd.collect()}
    assert (10, "short") in kept and (5, "short") not in kept
    assert drop_exact_copies(none).count() == 0


def test_one_id_under_two_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "doc_id long, text string")
    assert sorted(tuple(r) for r in drop_exact_copies(docs).collect()) == [(1, "b"), (2, "a")]


def check_law(rows, n, shards=8):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n and all(n // shards <= counts.get(s, 0) <= -(-n // shards) for s in range(shards))
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_shards(spark, odd, none):
    rows = shard_documents(odd).collect()
    check_law(rows, odd.count())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].size == 1 and by_id[9].size == 101 and by_id[9].text_crc32 == zlib.crc32(("é" * 50).encode())
    assert shard_documents(none).count() == 0


def test_groups_stay_together_and_hot_ones_fill_shards(spark):
    texts = [f"text {i}" for i in range(600)] + [f"copy {i % 60}" for i in range(300)] + ["hot"] * 450
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shard_documents(docs).collect()
    check_law(rows, len(texts))
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    cut = sum(len(v) > 1 for k, v in where.items() if k != "hot")
    assert cut <= 12 and len(where["hot"]) <= 6


def test_string_ids_and_clashing_names(spark):
    rows = [("a", "same text", "x"), ("b", "same text", "y"), (None, "same text", "z"), ("c", "other text", "w"), (None, "alone", "v"), ("d", None, "u"), ("e", "", "t")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, `__wm_full` string")
    kept = sorted((r.doc_id or "-", r["__wm_full"]) for r in drop_exact_copies(docs).collect())
    assert kept == [("-", "v"), ("b", "y"), ("c", "w"), ("e", "t")]
    assert drop_exact_copies(docs).columns == docs.columns and drop_exact_copies(docs.limit(0)).count() == 0
    assert {(r.doc_id, r.keep_id) for r in exact_groups(docs.where("doc_id is not null")).collect()} == {("a", "b"), ("b", "b"), ("c", "c"), ("d", "e"), ("e", "e")}


def cut_pairs(rows, texts):
    """Pairs of equal texts in different shards, and all pairs, by counting."""
    groups = defaultdict(Counter)
    for r in rows:
        groups[texts[r.doc_id]][r.shard] += 1
    pairs = sum(n * (n - 1) // 2 for g in groups.values() for n in [sum(g.values())])
    return pairs - sum(n * (n - 1) // 2 for g in groups.values() for n in g.values()), pairs


def test_swaps_gather_where_every_text_has_a_copy(spark):
    texts = [f"text {i // 2}" for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shard_documents(docs).collect()
    check_law(rows, len(texts))
    cut, pairs = cut_pairs(rows, texts)
    assert cut < 0.1 * pairs


def plain_propagation(where, groups, shards, capacity):
    """Label propagation one member at a time, to a shard with more of its group and a free place, until nothing moves."""
    load, moved = Counter(where.values()), True
    while moved:
        moved = False
        for members in groups.values():
            for d in members:
                held = Counter(where[m] for m in members)
                best = max((s for s in range(shards) if s == where[d] or load[s] < capacity), key=lambda s: (held[s], -s))
                if (held[best], -best) > (held[where[d]], -where[d]):
                    load[where[d]] -= 1
                    load[best] += 1
                    where[d], moved = best, True
    return where


def test_cut_is_near_plain_propagation(spark):
    rng = random.Random(4)
    for hot in (0, 150):
        texts = [f"t{rng.randrange(250)}" for _ in range(900)] + ["hot"] * hot + [f"alone {i}" for i in range(400)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = shard_documents(docs).collect()
        check_law(rows, len(texts))
        groups = defaultdict(list)
        for i, t in enumerate(texts):
            groups[t].append(i)
        groups = {t: g for t, g in groups.items() if len(g) > 1}
        start = {i: rng.randrange(8) for g in groups.values() for i in g}
        where = plain_propagation(dict(start), groups, 8, len(texts) // 8)
        cut, pairs = cut_pairs(rows, texts)
        count = lambda w: sum(w[a] != w[b] for g in groups.values() for k, a in enumerate(g) for b in g[k + 1 :])
        assert cut <= count(where) + 0.1 * pairs and cut < 0.25 * count(start)


def test_sharding_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = catalog.op9_sharding(spark, "/root/testdata/sf0.001").collect()
    check_law(rows, len(docs))
    text = {d.doc_id: (d.text or "").encode() for d in docs}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "rows", None) for r in rows)
