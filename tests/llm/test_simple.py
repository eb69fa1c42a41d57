"""Operators 1, 2, 7, 8 and 10 against brute force, round trips and held-out accuracy."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslattice.llm import bpe, decontam, langid, media, warc

ODD = [(1, None), (2, ""), (3, "a"), (4, "Ünïcode ΣΑΣ İ ſ don't we'll 3.14 \x1c\x85 x"), (5, "w " * 40_000), (6, "same text"), (6, "same text"), (7, "<|endoftext|>Hi<|startoftext|> <|x|>"), (8, "x" * 30_000), (9, " \n\t "), (10, "日本語 é ﬁ ½ ²")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "k": F.lit(1), "score": F.lit(2)})


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_media(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = {}
    for k, t in docs.collect():
        raw = (t or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.setdefault((k, len(raw), len(pay), digest(pay), zlib.crc32(pay[-16:])), 0)
        want[k, len(raw), len(pay), digest(pay), zlib.crc32(pay[-16:])] += 1
    got = media.media_columns(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert want[tuple(r[:5])]
        assert r.media_bytes > r.payload_bytes and re.fullmatch("[0-9a-f]{16}", r.feature)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add(tuple(r[1:9]))
    assert all(len(x) == 1 for x in by.values())
    assert media.media_columns(docs.limit(0)).count() == 0


def test_image_formats():
    img = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_ppm(img)) == img).all() and (media.decode(media.encode_bmp(img)) == img).all()
    g = img[:, :, :1]
    assert (media.decode(media.encode_ppm(g)) == g).all()
    plain = b"P3 # c\n7 5\n255\n" + b" ".join(b"%d" % x for x in img.ravel())
    assert (media.decode(plain) == img).all()
    assert media.decode(b"P1\n3 1\n1 0 1")[:, :, 0].tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000]))[:, :, 0].tolist() == [[0, 255, 0]]
    total = media.integral(g[:, :, 0].astype(np.int64))
    assert np.allclose(media.area(total, 5, 7), g[:, :, 0]) and np.isclose(media.area(total, 1, 1), g.mean()).all()
    up = np.repeat(np.repeat(g[:, :, 0].astype(float), 4, 0), 3, 1).reshape(4, 5, 3, 7).mean((1, 3))
    assert np.allclose(media.area(total, 4, 3), np.repeat(np.repeat(g[:, :, 0].astype(float), 4, 0), 3, 1).reshape(4, 5, 3, 7).mean((1, 3))), up


def brute_hits(text, items, n):
    split = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))))
    words = split(text)
    hit, ids = set(), set()
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - n + 1)) if w else ():
            p = w[a : a + n]
            for s in range(len(words) - len(p) + 1):
                if words[s : s + len(p)] == p:
                    hit.update(range(s, s + len(p)))
                    ids.add(str(i))
    return len(words), len(hit), len(ids), digest(",".join(sorted(ids)).encode()), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_decontamination(spark, sf, odd, block):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()] + [(100, "a"), (101, "Same, TEXT"), (102, None), (103, "  "), (100, "a"), (104, "and the other of")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).union(odd.where("doc_id not in (5, 8)").select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(900, "zz " + items[2][1].upper() + " zz"), (901, " ".join(items[3][1].split()[3:14]))], "doc_id long, text string"))
    bench = spark.createDataFrame([*items, (None, "same text")], "item_id long, text string")
    rows = docs.collect()
    got = {}
    for r in decontam.decontaminate(docs, bench, 10, block).mapInArrow(decontam._digests, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean").collect():
        got.setdefault(r[0], set()).add(tuple(r[1:]))
    for k, t in rows:
        assert brute_hits(t, items, 10) in got[k], (k, t)
    assert decontam.decontaminate(docs, bench.limit(0)).where("runs is not null").count() == 0


def test_bpe(spark, sf, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation(), t.no_padding()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = {}
    for r in bpe.encode(docs, digests=True).collect():
        got.setdefault(r[0], set()).add(tuple(r[1:]))
    for k, text in docs.collect():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want = len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(t.decode(ids, skip_special_tokens=False).encode())
        assert want in got[k], (k, text[:50])
    c = bpe.coder(bpe.default_path())
    raw, text = c.encode(["Hello <|endoftext|> wörld"])[0]
    assert c.decode(raw) == text


def test_langid(spark, sf, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    x = r.where("held_out and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert x[0] > 0.97 and x[1] > 200
    profiles = langid.fit(docs)
    got = {k: (p, s) for k, p, s in langid.predict(odd, profiles).select("doc_id", "lang_pred", "score").collect()}
    assert got[1] == got[2] == got[9] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values()) and got[3][0] != "und" and got[10][0] != "und"
    assert langid.predict(odd, {}).where("lang_pred = 'und'").count() == odd.count()
    assert langid.predict(odd, profiles).columns == ["doc_id", "text", "lang", "k", "lang_pred", "score"]


def test_warc(spark, sf):
    pages = spark.createDataFrame([(1, "http://a/", "<html><head><title> T </title></head><body><p>Hi &amp; <b>you</b><br>x<script>no</script><a href=x>l</a></p></body></html>"), (2, None, None), (3, " ", "HTTP/1.1 404 No\r\nX-A: b\r\n\r\n<p>gone</p>"), (None, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {(r.page_id, r.record_type): r for r in warc.derive(pages).collect()}
    assert got[1, "conversion"].block == "Hi & you\nxl" and got[2, "conversion"].block == ""
    assert got[3, "metadata"].source_headers == "HTTP/1.1 404 No\r\nX-A: b\r\n" and got[3, "conversion"].block == "gone" and got[3, "conversion"].target_uri is None
    assert "title: T\r\noutlinks: 1\r\n" in got[1, "metadata"].block
    for r in got.values():
        assert r.block_digest == "sha256:" + digest(r.block.encode()) and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", r.record_id)
        assert got[r.page_id, "conversion"].refers_to == got[r.page_id, "metadata"].refers_to
    rec = {(r.page_id, r.record_type): bytes(r.record) for r in warc.as_records(warc.derive(pages)).collect()}[1, "conversion"]
    head, _, rest = rec.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: conversion") and b"Content-Length: 11" in head and rest == b"Hi & you\nxl\r\n\r\n"
    assert warc.op1_warc_derivatives(spark, sf).count() == 2 * spark.read.parquet(f"{sf}/pages.parquet").count()
