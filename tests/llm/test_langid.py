"""Operator 10: profiles and distances against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from saleslattice.llm import langid


def brute_grams(text):
    s = [0, *(b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in (text or "").lower().encode()), 0]
    out = Counter()
    for i in range(len(s)):
        for n in (1, 2, 3):
            g = s[i : i + n]
            if len(g) == n and (any(g) if n < 3 else g[1]):
                code = 0
                for x in g:
                    code = code * 155 + x
                out[code * 4 + n] += 1
    return out


def ranked(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def brute_predict(text, profiles):
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    mine = ranked(brute_grams(text), 300)
    far = {lang: sum(min(abs(p.index(g) - i), 400) if g in p else 400 for i, g in enumerate(mine)) for lang, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (400 * len(mine))


@pytest.fixture(scope="module")
def rows(spark, sf):
    rnd = random.Random(2)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()]
    odd = [None, "", "a", "Zz", "123 !", "ab ab", "ÅÄÖ ß", "日本", "x" * 5000, "w é " * 30_000, "".join(rnd.choice("qxzjvk ") for _ in range(900)), "a", "a"]
    return docs + [(9000 + k, t, [None, "en", "zz"][k % 3]) for k, t in enumerate(odd)]


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want = {}
    for _, t, lang in rows:
        if lang is not None:
            want.setdefault(lang, Counter()).update(brute_grams(t))
    want = {k: ranked(c, 400) for k, c in want.items() if c}
    profiles = langid.fit(df)
    assert profiles == want
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, profiles).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        lang, score = brute_predict(t, want)
        assert got[k][0] == lang and got[k][1] == pytest.approx(score), (k, t)


def test_small_limits(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = langid.fit(df)
    monkeypatch.setattr(langid, "HELD", 100)
    monkeypatch.setattr(langid, "PARTS", 3)
    assert langid.fit(df.repartition(3)) == want


def test_edges(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert langid.fit(none) == {} and langid.predict(none, {}).count() == 0
    tie = spark.createDataFrame([("ab", "y"), ("ab", "x"), ("ab", None)], "text string, lang string").withColumns({"score": F.lit("s"), "lang_pred": F.lit(0)})
    assert {tuple(r) for r in langid.predict(tie, langid.fit(tie)).select("lang_pred", "score").collect()} == {("x", 1.0)}


def test_slices_of_long_texts(monkeypatch):
    """A text counted in slices has the n-grams of the whole, wherever the cuts fall."""
    import random

    rng = random.Random(1)
    text = "".join(rng.choice("abcé  \n1.ü") for _ in range(5000)).encode()
    whole = [x.tolist() for x in langid._tallied([text])]
    for size in (1, 2, 3, 7, 1000, 4999, 5001):
        monkeypatch.setattr(langid, "SLICE", size)
        assert [x.tolist() for x in langid._tallied([text])] == whole
        assert [x.tolist() for x in langid._tallied([text], np.array([3]))] == [[k + (3 << langid.WIDTH) for k in whole[0]], whole[1]]


def test_memory_of_a_long_text():
    import tracemalloc

    ranker = langid.Ranker({"a": list(range(4, 400, 4)), "b": list(range(400, 4, -4))})
    batch = pa.RecordBatch.from_arrays([pa.array(["Words of a Long text. " * 1_400_000])], names=["text"])
    tracemalloc.start()
    ranker.of(batch, "text")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400e6  # 31 MB of text
