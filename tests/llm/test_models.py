"""Toxicity, context mixing, personal data, main text and the pipeline."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import catalog, pii, toxicity
from waymark.llm.main_text import extract_main_text, main_text


def test_pairs_that_harm_together(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        words = [f"n{rng.randrange(300)}" for _ in range(25)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["rotten"] * insult + ["people"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, marks)).withColumn("held", toxicity.fold(F.col("doc_id"), 5) == 0).collect()
    truth = dict(labels)
    held = [(r.score >= 0.5) == truth[r.doc_id] for r in scored if r.held]
    assert sum(held) / len(held) > 0.95


def test_toxicity_edges(spark, odd, none):
    marks = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, marks)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = toxicity.train(odd, marks.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(odd, empty).collect()} == {0.5}
    assert toxicity.score(none, empty).count() == 0
    assert toxicity.drop_toxic(odd, marks.limit(0), threshold=0.6).columns == odd.columns


def brute_pii(text):
    out = []
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    for kind, pattern in enumerate(patterns, 1):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 2:
                ok = all(int(p) <= 255 for p in m[0].split("."))
            else:
                ok = kind == 1 or (16 <= len(digits) <= 19 and pii.luhn(digits) if kind == 3 else 8 <= len(digits) <= 15)
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    alphabet = "a1.@+-4 (5)9%_0"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        text += rng.choice(["", " 4539578763621486", " +1 (974) 555-3436", " 1.2.3.4.5.6.7.8", " a.b@c.d@e.f"])
        assert pii.base_spans(text) == brute_pii(text), text


def test_repeated_entities(spark, odd, none):
    text = "Call +1 (974) 555-3436 or mail die.55@mail4.example.com. Again 974-555-3436; die.55 (at) mail4.example.com or die.55. é 7536784127813050 4845168114407329."
    docs = [(i, text) for i in range(3)] + [(9, "clean words only 12345678")]
    docs += [(20 + i, f"card {4539578763621486} and mail x{i}@y.org") for i in range(30)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    found = {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in rows[0].spans.split(","))}
    assert {"974-555-3436", "die.55 (at) mail4.example.com", "die.55@mail4.example.com", "4845168114407329"} <= found
    base = ",".join(f"{pii.KINDS[k - 1]}:{a}:{b}" for k, a, b in sorted(brute_pii(text)))
    assert rows[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert rows[9].spans == "" and rows[9].n_phone == 0
    assert "[email]" in pii.redact(text, rows[0].spans) and "die.55@" not in pii.redact(text, rows[0].spans)
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(none).count() == 0


def small_field():
    """Trained on texts with phones and cards, some repeated, and plain serial numbers."""
    rng = random.Random(11)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    seen = Counter()
    for _ in range(400):
        phone, serial = f"+1 ({number(3)}) 555-{number(4)}", number(10)
        for text in (f"Call {phone} or later {phone}, order {serial}.", f"Orders {serial} and {number(9)}; again {serial}.", f"Card 4539578763621486 of x.{number(3)}@y.org and {phone}"):
            seen.update(pii.examples(text))
    return pii.Field([(*k, n) for k, n in sorted(seen.items())])


def test_many_bare_repeats_of_a_number():
    field = small_field()
    for repeats in (1, 5, 6, 50):
        text = "Call +1 (974) 555-3436 now." + " Or dial 974-555-3436 there." * repeats
        assert len(pii.added_spans(text, pii.base_spans(text), field)) == repeats
    clean = "Serial 974-555-3436 here." * 50 + " Call +1 (202) 555-0188 now."
    assert pii.added_spans(clean, pii.base_spans(clean), field) == []


def test_training_finds_agreement():
    field = small_field()
    assert field.skip[4, 4] > 1 > 0 > field.skip[0, 4] and field.skip[0, 0] > 0
    assert np.allclose(field.skip, field.skip.T) and np.allclose(field.chain, field.chain.T)
    none = pii.Field([])
    assert not none.skip.any() and none.observe("n10")[[0, 4]].tolist() == [0, 0]


def enumerated(unary, edges, potentials):
    n, k = unary.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        score = sum(unary[i, y] for i, y in enumerate(labels)) + sum(t[labels[a], labels[b]] for (a, b), t in zip(edges, potentials, strict=True))
        for i, y in enumerate(labels):
            out[i, y] += np.exp(score)
    return out / out.sum(1, keepdims=True)


def test_beliefs_equal_enumeration():
    rng = np.random.default_rng(2)
    for n in (2, 4, 6):
        edges = np.array([(int(rng.integers(i)), i) for i in range(1, n)])
        unary, potentials = rng.normal(size=(n, 3)), rng.normal(size=(n - 1, 3, 3))
        assert np.allclose(pii.beliefs(unary, edges, potentials), enumerated(unary, edges, potentials), atol=1e-3)
    ring = np.array([(0, 1), (1, 2), (2, 3), (0, 3)])
    unary, potentials = rng.normal(size=(4, 3)), 0.5 * rng.normal(size=(4, 3, 3))
    assert np.allclose(pii.beliefs(unary, ring, potentials), enumerated(unary, ring, potentials), atol=0.03)


def test_long_lists_of_numbers_are_near_linear():
    rng, field = random.Random(5), small_field()
    took = []
    for n in (4000, 16_000):
        text = "Call +1 (974) 555-3436 now: " + " ".join(f"{rng.randrange(10**9, 10**10)} and x" for _ in range(n)) + " 974-555-3436"
        began = time.process_time()
        spans = pii.added_spans(text, pii.base_spans(text), field)
        took.append(time.process_time() - began)
        assert any(text[a:b] == "974-555-3436" for _, a, b in spans)
    assert took[1] < 8 * took[0] + 1


def test_pii_query(spark):
    rows = {r.doc_id: r for r in catalog.op10_pii(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base = brute_pii(d.text or "")
        r = rows[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in (1, 2, 3, 4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k - 1]}:{a}:{b}" for k, a, b in sorted(base)).encode()).hexdigest()
        spans = [(pii.KINDS.index(k) + 1, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans) and spans == sorted(spans)


def test_self_closing_svg_and_math():
    for tag in ("<svg/>", "<svg class='i' />", '<math display="block"/>'):
        assert main_text(f"<body><article><p>Before it.</p>{tag}<p>After it.</p></article></body>") == "Before it. After it."
    assert main_text("<body><article><p>Before it.</p><svg><text>drawn</text></svg><p>After it.</p></article></body>") == "Before it. After it."


def test_main_text(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Head &amp; tail</h1><p><b>First para<br>graph one.<p>Sec<i>ond</i> paragraph.</p><script>x('</p>')</script><form>f</form></article>"
        "<div id='comments'><p>Nice post, really nice post indeed.</p></div><footer>&copy; x</footer></body></html>"
    )
    assert main_text(page) == "Head & tail First para graph one. Second paragraph."
    plain = "<body><div class=menu><a href=1>a</a></div><div><p>" + "Long text here. " * 9 + "</p><p>" + "More of it. " * 9 + "</p></div><div id=footer>foot</div></body>"
    assert main_text(plain).startswith("Long text here.") and main_text(plain).endswith("More of it.") and "foot" not in main_text(plain)
    for odd_page in (None, "", "<", "<!--", "<a href=", "<p>&amp", "<div>" * 5000 + "x", "</p></div>", "<script>never closed"):
        assert isinstance(main_text(odd_page), str)
    rows = extract_main_text(spark.createDataFrame([(1, None, "old"), (1, page, "old")], "page_id long, html string, text string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, 0), (1, len(main_text(page)))]


def test_pipeline_stages(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(3, 0), (5, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no id here at all in this row")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} >= {4, 7, 9, 10} and not {3, 5, 8} & {r.doc_id for r in rows}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_logits_are_sums_over_pairs():
    rng = np.random.default_rng(4)
    model = toxicity.Model(-0.3, np.array([2, 5, 9, 11, 40]), rng.normal(size=5), rng.normal(size=(5, 3)))
    rows = [[2, 5, 7], [], [9], [2, 5, 9, 11, 40, 41], [1, 3]]
    got = model.logits(np.concatenate([np.array(r, np.int64) for r in rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for logit, row in zip(got, rows, strict=True):
        at = [int(np.flatnonzero(model.slot == t)[0]) for t in row if t in model.slot]
        want = model.bias + sum(model.weight[i] for i in at)
        want += sum(model.factor[i] @ model.factor[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert abs(logit - want) < 1e-9


def test_linear_weights_alone_miss_the_pair():
    rng = np.random.default_rng(6)
    both = rng.random((3000, 2)) < 0.5
    labels = (both[:, 0] ^ both[:, 1]).astype(float)
    rows = [[1000 + rng.integers(50), *np.flatnonzero(b)] for b in both]
    flat = np.array([t * 1024 for r in rows for t in sorted(map(int, r))], np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    right = lambda m: float(((m.logits(flat, bounds) > 0) == (labels > 0)).mean())
    assert right(toxicity.fit(flat, bounds, labels)) > 0.95
    assert right(toxicity.fit(flat, bounds, labels, factors=0)) < 0.8


def test_sample_bounds_and_repeated_ids(spark):
    rows = [(i, f"word{i % 7} bad" if i % 2 else f"word{i % 7} good") for i in range(200)] + [(3, "word3 bad")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    small = toxicity.train(docs, marks, sample_terms=40)
    model = toxicity.train(docs, marks)
    assert len(small.slot) < len(model.slot)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(200)) and abs(model.bias) < 1


def test_toxicity_query(spark):
    rows = catalog.op5_toxicity(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = {r.doc_id for r in docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(r.held_out == (r.doc_id in held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_each_stage_alone(spark, odd, none, tmp_path):
    spark.createDataFrame([(3, 0), (5, 0), (9, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no id here at all in this row")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bare = odd.select("doc_id", "text", F.lit(1).alias("__wm_id"), F.lit(2).alias("__wm_row"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none, bare):
            got = stage(spark, docs, str(tmp_path))
            rows = got.collect()
            if name != "packing":
                assert got.columns == docs.columns and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
            assert (len(rows) > 0) == (docs is not none)
            if name == "exact_dedup" and docs is odd:
                assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [2, 4, 4, 6, 7, 8, None, 9, 10]))
