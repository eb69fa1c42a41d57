"""The pipeline's stages on a small corpus against their brute-force versions."""

from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from test_groups import brute_components, brute_lines
from test_langid import brute_grams, brute_predict, ranked
from test_simple import brute_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [None, "123 ... !!", "", "Быстрая коричневая лиса прыгает через ленивую собаку", "Szybki brązowy lis przeskakuje nad leniwym psem", "d13836822265d0bf976f7deb6f28d60cf2cd1be0" * 9, "zxvx wjx qwwq vjxkqqqqwjwqj jkjj vqwx " * 5]
    extra = spark.createDataFrame([(9001 + k, t, None, None, None) for k, t in enumerate(odd)], docs.schema)
    docs = docs.unionByName(extra)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen, labels = ({r.doc_id: r[c] for r in docs.collect()} for c in ("text", "lang"))
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r["text"] if "text" in docs.columns else None for r in docs.collect()}
        assert len(got) == docs.count()
        if name == "language_id":
            profiles = {lang: Counter() for lang in labels.values() if lang}
            for k, t in seen.items():
                if labels[k]:
                    profiles[labels[k]].update(brute_grams(t))
            profiles = {k: ranked(c, 400) for k, c in profiles.items()}
            scores = {k: brute_predict(t, profiles) for k, t in seen.items()}
            want = {k: t for k, t in seen.items() if scores[k][0] != "und" and scores[k][1] >= P.LEAST_SCORE}
            gone = seen.keys() - want.keys()
            assert {9001, 9002, 9003, 9004, 9005, 9007} <= gone <= {9000 + k for k in range(1, 8)}, gone
        elif name == "line_dedup":
            want = {k: t for k, (_, gone, t) in brute_lines(sorted(seen.items()), 2).items() if t or not gone}
        elif name == "near_dedup":
            want = {k: seen[k] for k, (_, c) in brute_components(list(seen.items()), 5).items() if c == k}
        elif name == "decontaminate":
            want = {k: t for k, t in seen.items() if not brute_hits(t, bench, 10)[-1]}
        else:
            want = dict.fromkeys(seen)
        assert got == want, name
        assert len(got) <= len(seen) and (name == "bpe_encode" or docs.columns == P.COLUMNS)
        seen = got
    assert P.run(spark, SF).where(~F.col("doc_id").isin(*seen)).count() == 0


def test_rows_of_one_id(spark):
    a, b, c = "a b c d e f g", "other words here and there " * 9, "a third text of another kind " * 9
    rows = [(1, a, "en", "s", 3), (1, a, "en", "r", 9), (2, a, "de", "s", 3), (4, b, "en", "s", 3), (4, c, "en", "s", 3), (None, a, "en", "s", 3), (None, a, "en", "s", 3), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [rows[1], *rows[3:]]
    for n in (1, 5):
        assert sorted(map(tuple, P.near_dedup(spark, docs.repartition(n), SF).collect()), key=str) == sorted(want, key=str)
