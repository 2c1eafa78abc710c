"""Packing against the tokenizer and by law; archives by round trip."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import catalog, packing, warc
from waymark.llm.bpe import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(text):
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    return whole.encode(text, add_special_tokens=False).ids


def test_encoder_equals_tokenizers():
    words = Encoder(PATH, cache_words=3)
    texts = ["", " ", "a", " lead and trail ", "two  spaces   three", "line\nbreak\n\n x", "don't we'll I'M", "123 4567 ab12", "é ß 中文 🙂 x", "tab\there", "a b   c", "<|endoftext|> x", "x" * 500]
    for text in [*texts, " ".join(texts), "  ".join(texts)]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == reference(text), text


def test_plan_fills_bins():
    hist = {1024: 5, 700: 3, 324: 4, 300: 2, 24: 10, 1: 7}
    runs = packing.plan_best_fit(hist, 1024)
    used = {}
    placed = dict.fromkeys(hist, 0)
    for length, rank, count, first, offset in runs:
        assert rank == placed[length]
        placed[length] += count
        for s in range(first, first + count):
            assert used.get(s, 0) == offset
            used[s] = offset + length
    assert placed == hist and max(used.values()) <= 1024
    assert len(used) <= -(-sum(k * n for k, n in hist.items()) // 1024) + 1
    assert packing.plan_best_fit({}, 1024) == []


def piece_by_piece(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_equals_best_fit_decreasing_piece_by_piece():
    rng = np.random.default_rng(5)
    for _ in range(400):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 60))
        hist = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        runs = packing.plan_best_fit(hist, capacity)
        seated = sorted((s, offset, length) for length, _, count, first, offset in runs for s in range(first, first + count))
        assert len({s for s, _, _ in seated}) == piece_by_piece(lengths.tolist(), capacity)
        for (s, offset, length), (s2, offset2, _) in zip(seated[:-1], seated[1:], strict=True):
            assert offset2 == offset + length if s == s2 else offset2 == 0
        assert max(offset + length for _, offset, length in seated) <= capacity
    assert {r[3] + i for r in packing.plan_best_fit({300: 4}, 1024) for i in range(r[2])} == {0, 1}


def test_packing_query(spark):
    rows = catalog.op2_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    words, ids = Encoder(PATH), {}
    for d in docs:
        ids[d.doc_id] = np.append(np.frombuffer(words.encode(d.text or ""), "<u4"), 2).astype("<u4")
    for r in rows:
        assert r.length <= 1024 and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert len({r.sequence_id for r in rows}) == piece_by_piece([r.length for r in rows], 1024)


def test_pack(odd, none):
    rows = packing.pack(odd, PATH, capacity=64, with_ids=True).collect()
    assert packing.pack(none, PATH).count() == 0
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for key in (1, 3, 7, 9, None):
        ids = [*reference(texts[key]), 2]
        parts = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.piece)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        assert [i for r in parts for i in r.ids] == ids and all(r.length == 64 for r in parts[1:])
        assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in parts)
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 64 and len(bins) <= sum(r.length for r in rows) // 64 + 2


def test_archives(spark, tmp_path):
    pages = [(1, "http://a/", "x" * 5000), (2, "http://b/\n", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "ü", "head\r\n\r\nbody é"), (2, "http://b/", "same"), (None, "n", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    manifest = warc.write_archives(df, "page_id", "url", "html")
    chunks = warc.read_chunks(manifest, chunk_bytes=1024).cache()
    rows = warc.record_digests(chunks).collect()
    assert len(rows) == len(pages) and all(r.intact for r in rows)
    for key, _, html in pages:
        body = (html or "").encode()
        mine = [r for r in rows if r.record_id == key]
        assert all((r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()) for r in mine)
    kinds = {r.record_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds[3] == ("revisit", 2) and kinds[2] == ("response", None) and kinds[5] == ("revisit", 4) and kinds[None] == ("response", None)
    got = {r.record_id: bytes(r.payload).decode() for r in warc.payloads(chunks).collect()}
    assert got[1] == "x" * 5000 and got[6] == "head\r\n\r\nbody é" and got[4] == ""
    assert chunks.where("record_id = 1").count() == 5
    assert warc.record_digests(warc.read_chunks(warc.write_archives(df.limit(0), "page_id", "url", "html"))).count() == 0


def test_small_payloads_never_revisit(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    rows = warc.record_digests(warc.read_chunks(warc.write_archives(df, "page_id", "url", "html", min_revisit_bytes=3))).collect()
    assert sorted((r.record_id, r.refers_to) for r in rows if r.record_type == "revisit") == [(4, 3)]


def test_long_payloads_go_in_chunks(spark):
    long = "0123456789abcdef" * (5 << 20)
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "y")], "page_id long, url string, html string")
    df = df.select("page_id", "url", F.when(F.col("page_id") == 1, F.expr(f"repeat('0123456789abcdef', {5 << 20})")).otherwise(F.col("html")).alias("html"))
    manifest = warc.write_archives(df, "page_id", "url", "html", file_bytes=1 << 20)
    rows = {r.record_id: r for r in warc.record_digests(warc.read_chunks(manifest, with_data=False), strict=True).collect()}
    assert (rows[1].payload_bytes, rows[1].payload_digest) == (len(long), base64.b32encode(hashlib.sha1(long.encode()).digest()).decode())
    chunks = warc.read_chunks(manifest).where("record_id = 1")
    assert chunks.count() == 80 and chunks.agg(F.max(F.octet_length("data"))).first()[0] == 1 << 20
    assert sum(r.records for r in manifest.collect()) == 2


def test_files_roll_and_damage_is_an_error(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 500).alias("html")).coalesce(1)
    manifest = warc.write_archives(df, "page_id", "url", "html", folder=f"file://{tmp_path}/a", file_bytes=4000, chunk_bytes=300)
    files = manifest.collect()
    assert len(files) > 4 and sum(f.records for f in files) == 40
    assert warc.record_digests(warc.read_chunks(manifest), strict=True).count() == 40
    path = files[0].path.removeprefix("file://")
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(data.replace(b"777", b"778", 1) if b"777" in data else data.replace(b"000", b"001", 1))
    assert warc.record_digests(warc.read_chunks(manifest)).where("not intact").count() == 1
    with pytest.raises(Exception, match="declares"):
        warc.record_digests(warc.read_chunks(manifest), strict=True).collect()


def test_warc_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    want = {tuple(r) for r in db.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to, intact from ({catalog.OP1_SQL})").fetchall()}
    got = {tuple(r) for r in catalog.op1_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()}
    assert got == want and len(got) == 250
