"""Context mixing against a plain-Python coder, sums over closed alphabets, and odd inputs."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import bits, catalog, mixing
from waymark.llm.words import mix, split_words, windows

M64 = (1 << 64) - 1


def some_docs(count=250, seed=3):
    rng = random.Random(seed)
    bits_ = ["ba", "to", "ri", "ne", "sol"]
    word = lambda: "".join(rng.choice(bits_) for _ in range(rng.randrange(1, 4)))
    docs = []
    for i in range(count):
        own = [word() for _ in range(12)]
        docs.append((i, " ".join(rng.choice(own) for _ in range(rng.randrange(20, 80)))))
    return docs


def test_base_and_counts(spark, odd, none):
    docs = some_docs() + [(300, None), (301, "Ba  BA\tunseen"), (None, "ba")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in mixing.score_documents(df, "id % 7 <> 2").collect()}
    tokens = {i: [*(t or "").lower().split(), ""] for i, t in docs}
    seen = Counter(w for i, ws in tokens.items() if i is None or i % 7 != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for i, ws in tokens.items():
        r = rows[i]
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(seen[w] > 0 for w in ws), n)
        assert r.held_out == (i is not None and i % 7 == 2) and r.score < 0
        size = len((dict(docs)[i] or "").encode())
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / max(1, size))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert mixing.score_documents(none).count() == 0
    untaught = mixing.score_documents(odd, "false").collect()
    assert len(untaught) == odd.count() and all(r.n_known == 0 and math.isfinite(r.score) for r in untaught)


def plain_cost(mixer, slots, kind, bit):
    shape, odds, seen = mixer.shape, [], []
    for p, slot in enumerate(slots):
        code = int(mixer.codes[shape.starts[p] + slot])
        zeros, ones = (2 ** (c / 8) - 1 for c in (code & 255, code >> 8))
        odds.append(math.log((ones + shape.prior[p]) / (zeros + shape.prior[p])))
        seen.append(round(zeros + ones))
    level = lambda n: (n > 0) + (n > 2) + (n > 7) + (n > 63)
    w = mixer.weights[kind * 25 + level(seen[shape.gate_by[0]]) * 5 + level(seen[shape.gate_by[1]])]
    mixed = min(11.999, max(-12.0, sum(float(a) * o for a, o in zip(w, [*odds, 1.0], strict=True))))
    column = (mixed + 12) * 2
    low = int(column)
    curve = mixer.refine[kind * 49 + low] * (1 - column + low) + mixer.refine[kind * 49 + low + 1] * (column - low)
    final = 0.5 * (mixed + curve)
    return math.log1p(math.exp(-final if bit else final))


def plain_score(model, counts, text):
    """Token by token, bit by bit, with dictionaries."""
    lex, cells = model.lexicon, len(model.lexicon.length)
    column = pa.array([text])
    h = [int(x) for x in split_words(column, 0, 1).hashes] + [int(mixing._END)]
    names = [w.encode() for w in text.lower().split()] + [b""]
    mix1 = lambda x: int(mix(np.array([x & M64], np.uint64))[0])
    place = lex.head.find(np.array(h, np.uint64))
    cell = [int(lex.head.cell[p]) if p >= 0 else cells - 1 for p in place]
    last, run, own, experts = {}, 0, Counter(), [0.0] * len(mixing.EXPERTS)
    start = int(mixing._START)
    for t, word in enumerate(h):
        one, two = h[t - 1] if t else start, h[t - 2] if t > 1 else start
        before, before2 = cell[t - 1] + 1 if t else 0, cell[t - 2] + 1 if t > 1 else 0
        contexts = (one >> 32, mix1(one * int(mixing._K1) + two) >> 32, ((before << 12) + before2) * 0xC2B2AE35 & 0xFFFFFFFF)

        def slots(node, contexts=contexts):
            turned = (node + 1) * int(mixing._A32)
            return [node, *(((c + turned) * int(mixing._B32) & 0xFFFFFFFF) >> (32 - b) for c, b in zip(contexts, lex.shape.bits[1:], strict=True))]

        log_p, hit = 0.0, False
        if (one, two) in last:
            hit = last[one, two] == word
            bucket = [0, 1, 2, 3, 3, 4, 4, 4, 4, 5][min(run, 9)]
            log_p -= plain_cost(model.words, slots(bucket), bucket, hit)
        last[one, two] = word
        run = run + 1 if hit else 0
        tail = None
        if not hit:
            for depth in range(lex.length[cell[t]]):
                kind = mixing._MATCHES + min(depth, mixing._DEPTHS - 1)
                log_p -= plain_cost(model.words, slots(int(lex.node[cell[t], depth])), kind, lex.bit[cell[t], depth])
            if counts[names[t]]:
                share = math.log(counts[names[t]] - lex.discount) - lex.log_weight[cell[t]]
            else:
                share, at = lex.log_unknown, mixing.spell([names[t]])
                for i in range(len(at.data)):
                    for bit in range(8):
                        found, came = at.slots(bit, model.spelling.shape.bits)
                        share -= plain_cost(model.spelling, [int(f[i]) for f in found], int(at.kind[i]) * 8 + bit, came[i])
            tail = share if place[t] < 0 else None
            log_p += share
        for e, weight in enumerate(mixing.EXPERTS):
            if hit or not weight or not t:
                experts[e] += log_p
            elif own[word] and tail is not None:
                experts[e] += math.log(weight * own[word] / t)
            else:
                experts[e] += math.log((1 - weight) * math.exp(log_p) + weight * own[word] / t)
        own[word] += 1
    top = max(experts)
    return (top + math.log(sum(math.exp(x - top) for x in experts) / len(experts))) / math.log(10)


@pytest.mark.parametrize("head_words", [40, 1 << 20])
def test_scores_equal_a_plain_coder(spark, monkeypatch, head_words):
    monkeypatch.setattr(mixing, "HEAD_WORDS", head_words)
    monkeypatch.setattr(mixing.fit, "__defaults__", (head_words,))
    docs = some_docs(60)
    texts = spark.createDataFrame([(t,) for i, t in docs if i % 7 != 2], "text string").coalesce(1)
    counts = Counter(w.encode() for i, t in docs if i % 7 != 2 for w in [*t.split(), ""])
    model, rest = mixing.fit(texts)
    assert rest.count() == sum(model.lexicon.head.find(split_words(pa.array([w.decode()]), 0, 1).hashes)[0] < 0 for w in counts if w)
    asked = [t for _, t in docs[:12]] + ["", "ba ba ba ba ba", "Never seen tori before, never seen", "x" * 40 + " tori"]
    monkeypatch.setattr(mixing, "fit", lambda _: (model, rest))
    rows = mixing.score_documents(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), "false").collect()
    for r in rows:
        assert math.isclose(r.score, plain_score(model, counts, asked[r.doc_id]), rel_tol=1e-4), asked[r.doc_id]


def test_probabilities_of_all_texts_sum_to_at_most_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "b a", "", "a a b b a", "b"] * 8)], "doc_id long, text string")
    model, rest = mixing.fit(docs.select("text"))
    monkeypatch.setattr(mixing, "fit", lambda _: (model, rest))
    words = ["a", "b", "c", "ab", "bb"]
    texts = [" ".join(t) for n in range(5) for t in itertools.product(words, repeat=n)]
    rows = mixing.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "false").collect()
    assert 0.2 < sum(10**r.score for r in rows) <= 1


def plain_step(learner, slots, kind, bit):
    """Learner.step written down plainly: each count read and raised by itself, in whatever types come out."""
    shape, odds, level = learner.shape, [], {}
    places = [2 * (slot.astype(np.int64) + start) for slot, start in zip(slots, shape.starts, strict=False)]
    for p, place in enumerate(places):
        zeros, ones = learner.counts.take(place), learner.counts.take(place + 1)
        level[p] = sum((zeros + ones > n).astype(np.int32) for n in (0, 2, 7, 63))
        odds.append(np.log((ones + shape.prior[p]) / (zeros + shape.prior[p])))
    gate = kind * 25 + level[shape.gate_by[0]] * 5 + level[shape.gate_by[1]]
    odds.append(np.ones(len(bit)))
    mixed = np.clip(sum(learner.weights[:, p].take(gate) * s for p, s in enumerate(odds)), -12, 11.999)
    error = bit - 1 / (1 + np.exp(-mixed))
    hit = np.bincount(gate, minlength=shape.gates)
    for p, s in enumerate(odds):
        grad = np.bincount(gate, error * s, shape.gates) / np.maximum(hit, 1)
        learner.square[:, p] += grad * grad
        learner.weights[:, p] += 0.15 * grad / np.sqrt(learner.square[:, p])
    learner.hits += hit
    for place in places:
        np.add.at(learner.counts, place + bit, np.ones(len(bit), np.uint32))


def test_learning_equals_a_plain_learner_at_less_cpu():
    rng = np.random.default_rng(4)
    shape = bits.Shape((12, 22, 22, 21), (0.4, 0.4, 0.3, 0.4), 12, (1, 2))
    lots = []
    for _ in range(4):
        slots = [(rng.zipf(1.3, 50_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - b)).astype(np.uint32) for b in shape.bits]
        lots.append((slots, rng.integers(0, 12, 50_000).astype(np.int32), (slots[1] % 3 == 0).astype(np.uint8)))
    took, learners = [[], []], [bits.Learner(shape), bits.Learner(shape)]
    for slots, kind, bit in lots * 6:
        for k, step in enumerate((bits.Learner.step, plain_step)):
            began = time.thread_time()
            step(learners[k], slots, kind, bit)
            took[k].append(time.thread_time() - began)
    fast, plain = learners
    assert np.array_equal(fast.counts, plain.counts) and np.array_equal(fast.hits, plain.hits) and fast.counts.sum() == 24 * 4 * 50_000
    assert np.allclose(fast.weights, plain.weights, rtol=1e-3, atol=1e-3)
    assert min(took[0]) < 0.77 * min(took[1])


def test_learners_leave_in_small_batches():
    learner = bits.Learner(bits.Shape((20, 18), (0.4, 0.4), 1, (0, 1)))
    learner.counts[:] = np.random.default_rng(1).integers(0, 1 << 16, len(learner.counts))
    batches = list(learner.batches())
    assert max(b.nbytes for b in batches) < 5 << 20 < sum(b.nbytes for b in batches)
    assert learner.rows().to_pylist() == [r for b in batches for r in b.to_pylist()]
    found = [r for b in bits._summed(iter(batches)) for r in b.to_pylist()]
    codes = np.concatenate([np.frombuffer(r["data"], np.uint8) for r in found[1:]])
    assert found[0]["block"] == -1 and np.array_equal(codes, bits._code(learner.counts))


def test_first_byte_is_a_distribution():
    learner = bits.Learner(mixing.spelling_shape(3))
    mixing.teach(learner, [b"abc", b"abd", b"x"] * 20)
    batch = learner.rows()
    state = np.frombuffer(batch.column(1)[0].as_py(), np.float64)
    mixer = bits.Mixer(learner.shape, bits._code(learner.counts), state)
    lot = mixing.spell([bytes([c]) for c in range(256)])
    cost = np.zeros(len(lot.data))
    for bit in range(8):
        slots, came = lot.slots(bit, learner.shape.bits)
        cost += mixer.cost(slots, lot.kind * 8 + np.int32(bit), came)
    assert math.isclose(np.exp(-cost[::2]).sum(), 1, rel_tol=1e-5)
    spelt = mixing.spelt(mixer, [b"abc", b"abq", b"z" * 500, b"z" * 5000])
    assert spelt[0] > spelt[1] and spelt[3] < spelt[2] < -500


def test_long_unknown_words_score_by_their_spelling(spark):
    docs = some_docs(60) + [(2, "z" * 50), (9, "z" * 500), (16, "z" * 5000)]
    rows = mixing.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), "id % 7 <> 2").collect()
    short, middle, long = sorted((r.score for r in rows if r.n_tokens == 2), reverse=True)[-3:]
    assert long < 5 * middle < 0 and middle < 5 * short < 0


def test_order_of_words_counts(spark):
    rng = random.Random(5)
    after = {w: [f"w{rng.randrange(60)}" for _ in range(2)] for w in (f"w{i}" for i in range(60))}

    def walk(n):
        words = ["w1"]
        while len(words) < n:
            words.append(rng.choice(after[words[-1]]))
        return words

    docs = [(i, " ".join(walk(60))) for i in range(400)]
    mixed = []
    for i in range(50):
        words = walk(60)
        mixed.append((1000 + 2 * i, " ".join(words)))
        rng.shuffle(words)
        mixed.append((1001 + 2 * i, " ".join(words)))
    rows = {r.doc_id: r.score for r in mixing.score_documents(spark.createDataFrame(docs + mixed, "doc_id long, text string"), "id < 1000").collect()}
    assert all(rows[1000 + 2 * i] > rows[1001 + 2 * i] + 10 for i in range(50))


def test_windows_cover_long_texts(spark, monkeypatch):
    texts = pa.array(["", "a bc", "word " * 50, "x" * 300 + " y", "é " * 40, "end"])
    raw = [t.encode() for t in texts.to_pylist()]
    found = [b""] * len(raw)
    for w in windows(texts, 64):
        pieces = [x if isinstance(x, bytes) else x.encode() for x in w.texts.slice(w.at, w.to - w.at).to_pylist()]
        for i, piece in enumerate(pieces):
            found[w.row + i] += piece
            assert len(piece) <= 64 or b" " not in piece.strip()
    assert found == raw
    docs = [(i, t) for i, t in some_docs(40)] + [(100, " ".join(t for _, t in some_docs(30, 9)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r for r in mixing.score_documents(df, "id % 7 <> 2").collect()}
    monkeypatch.setattr(mixing, "WINDOW_BYTES", 256)
    cut = {r.doc_id: r for r in mixing.score_documents(df, "id % 7 <> 2").collect()}
    for i, r in whole.items():
        assert (r.n_tokens, r.n_known) == (cut[i].n_tokens, cut[i].n_known) and math.isclose(r.base_score, cut[i].base_score, rel_tol=1e-12)
        assert abs(r.score - cut[i].score) < 0.25 * abs(r.score)


def test_the_query(spark):
    rows = catalog.op4_context_mixing(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")).collect()
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    split = lambda t: [w for w in "".join(c if not "A" <= c <= "Z" else c.lower() for c in t or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w] + [""]
    seen = Counter(w for d in docs if d.c % 7 != 2 for w in split(d.text))
    n, v = sum(seen.values()), len(seen)
    for r, d in zip(rows, docs, strict=True):
        assert r.held_out == (d.c % 7 == 2) and r.train_tokens == n and r.n_tokens == len(split(d.text))
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in split(d.text)), rel_tol=1e-9)
