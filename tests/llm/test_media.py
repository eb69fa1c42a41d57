"""Operator 2: depths of samples, hashes and tiles against sums over overlapping areas, and odd column names."""

import io
import random

import numpy as np
from pyspark.sql import functions as F

from saleslattice.llm import media


def weights(n, parts):
    """How much of each of n pixels lies in each of parts equal stretches."""
    out = np.zeros((parts, n))
    for k in range(parts):
        lo, hi = k * n / parts, (k + 1) * n / parts
        for i in range(n):
            out[k, i] = max(0.0, min(hi, i + 1) - max(lo, i))
    return out


def means(gray, rows, cols):
    a, b = weights(gray.shape[0], rows), weights(gray.shape[1], cols)
    return a @ gray @ b.T / np.outer(a.sum(1), b.sum(1))


def features(payload):
    img = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(np.int64)
    gray = (77 * img[:, :, 0] + 150 * img[:, :, 1] + 29 * img[:, :, 2]) >> 8
    a = np.round(means(gray, 8, 9), 6)
    bits = "".join("1" if x else "0" for x in (a[:, 1:] > a[:, :-1]).ravel())
    return f"{int(bits, 2):016x}", means(gray, 16, 16)


def test_hashes_and_tiles(spark, sf):
    rnd = random.Random(5)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    docs += [(5000 + n, "".join(chr(rnd.randrange(32, 1000)) for _ in range(n))) for n in (0, 1, 191, 192, 193, 383, 384, 385, 5000)] + [(6000, None), (6001, "x" * 300_000)]
    df = spark.createDataFrame(docs, "`a.id` long, `the.text` string").withColumns({"doc_id": F.lit("x"), "raw": F.lit(1), "tile": F.lit(2)})
    got = {r.doc_id: r for r in media.media_columns(df, "a.id", "the.text").collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        hash_, tile = features(media.payload_of((t or "").encode()))
        assert got[k].feature == hash_, k
        assert np.abs(np.load(io.BytesIO(got[k].tile)).astype(float) - tile).max() <= 0.5 + 1e-6


def test_depths():
    rng = np.random.default_rng(1)
    for most in (1, 15, 100, 255, 256, 1000, 65535):
        x = rng.integers(0, most + 1, (3, 5, 3))
        want = np.floor(x * 255 / most + 0.5 + 1e-9) if most % 2 == 0 else np.rint(x * 255 / most)
        plain = b"P3\n5 3\n%d\n" % most + b" ".join(b"%d" % v for v in x.ravel())
        raw = b"P6\n5 3\n%d\n" % most + x.astype(np.uint8 if most < 256 else ">u2").tobytes()
        assert (media.decode(plain) == want).all() and (media.decode(raw) == want).all(), most
