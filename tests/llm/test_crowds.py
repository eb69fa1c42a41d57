"""Operators 4 and 9: one passage in thousands of documents with different neighbours."""

import random

import pytest
from pyspark.sql import functions as F

from saleslattice.llm import _shards, fmindex, suffix

from test_substrings import brute_bytes, brute_words

MOST = 1500


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    hot = " ".join(f"h{rnd.randrange(10**6)}" for _ in range(40))
    own = lambda: " ".join(f"{rnd.randrange(10**6)}" for _ in range(25))
    return [(k, f"{own()} {hot} {own()}") for k in range(3000)]


@pytest.mark.parametrize("op", ["words", "bytes"])
def test_crowds_are_dealt_out(spark, rows, op, monkeypatch):
    real = _shards._first_places

    def watched(plan):
        inner, of, most = real(plan), _shards._of, MOST

        def run(table):
            n = sum(len(of(x, "<u4")) for x in table["lens"].to_pylist())
            if n > most:
                raise ValueError(f"{n} stretches in a bucket")
            return inner(table)

        return run

    monkeypatch.setattr(_shards, "_first_places", watched)
    monkeypatch.setattr(_shards, "SHARD_BYTES", 100_000)
    monkeypatch.setattr(_shards, "BUCKET_BYTES", 10_000)
    monkeypatch.setattr(_shards, "CROWD", 64, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, F.col("doc_id"))
    dedup, want = (fmindex.window_dedup, brute_words(rows, 20)) if op == "words" else (suffix.substring_dedup, brute_bytes(rows, 50))
    got = dedup(df, digests=True).collect()
    assert len(got) == len(rows) and all(tuple(r[1:]) in want[r[0]] for r in got)
