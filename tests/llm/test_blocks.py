"""Operator 7: a benchmark of many blocks goes past the driver, and one block is live at a time."""

import re

import pytest
from pyspark import SparkContext

from saleslattice.llm import decontam

from test_simple import brute_hits


def test_blocks(spark, sf, monkeypatch):
    def refused(*_):
        raise AssertionError("the benchmark was broadcast")

    monkeypatch.setattr(SparkContext, "broadcast", refused)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").repartition(3)
    items = [tuple(r) for r in bench.collect()]
    want = {r.doc_id: brute_hits(r.text, items, 10) for r in docs.collect()}
    got = decontam.decontaminate(docs, bench, 10, 2000)
    kept = decontam.clean(docs, bench, 10, 2000)
    for df in (got, kept):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id for r in kept.collect()} == {k for k, x in want.items() if not x[-1]} != set(want)
    assert {r.doc_id for r in got.where("runs is null").collect()} == {k for k, x in want.items() if not x[-1]}
    assert decontam.clean(docs, bench.limit(0)).count() == len(want)


def quick_hits(text, items, n):
    """brute_hits for long texts: every stretch of words is looked up among the windows of its length."""
    words, found = split(text), {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - n + 1)) if w else ():
            found.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    hit, ids = set(), set()
    for m in {len(w) for w in found}:
        for s in range(len(words) - m + 1):
            if (got := found.get(tuple(words[s : s + m]))) is not None:
                hit.update(range(s, s + m))
                ids |= got
    return len(words), len(hit), len(ids)


def split(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_long_texts_and_repeated_ids(spark, sf, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(-1, "w"), (-2, "zz y x")]
    docs = [(1, "w " * 40_000), (2, "v " * 30_000 + items[0][1] + " u" * 30_000), (3, "q" * 500_000), (4, "q" * 500_000 + " zz  Y\tx. " * 3), (5, "a"), (5, f"b {items[1][1]}"), (5, f"b {items[1][1]}"), (None, items[2][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    got = decontam.decontaminate(df, bench, 10, block).mapInArrow(decontam._digests, schema).collect()
    assert sorted(((r[0] or 0), r[1], r[2], r[3]) for r in got) == sorted((k or 0, *quick_hits(t, items, 10)) for k, t in docs)


def test_missing_blocks_are_errors(spark, tmp_path):
    """A folder or a block that a task can't find is no clean corpus; folders without a scheme are those of Spark."""
    bench = spark.createDataFrame([(f"i{i}", " ".join(f"w{i}x{j}" for j in range(12))) for i in range(40)], "item_id string, text string")
    where, blocks = decontam._write_blocks(bench, 10, 400)
    assert where.startswith("file:") and len(blocks) > 5
    assert all(decontam._read_block(where, k)[0] for k in blocks)
    for bad, k in ((f"file://{tmp_path}/none", 0), (where, max(blocks) + 1)):
        with pytest.raises(FileNotFoundError):
            decontam._read_block(bad, k)
    before = spark.conf.get("spark.checkpoint.dir")
    try:
        spark.conf.set("spark.checkpoint.dir", f"{tmp_path}/plain")
        at, found = decontam._write_blocks(bench, 10, 1 << 20)
        assert at.startswith("file:/") and found == [0] and decontam._read_block(at, 0)[0]
    except Exception as e:
        if "CANNOT_MODIFY" not in str(e):
            raise
    finally:
        try:
            spark.conf.set("spark.checkpoint.dir", before)
        except Exception as e:
            if "CANNOT_MODIFY" not in str(e):
                raise


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y")], "doc_id long, text string, items string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert sorted((r.doc_id, r.n_words, r.items) for r in decontam.decontaminate(docs, none).collect()) == [(1, 3, None), (2, 0, None)]
    assert decontam.clean(docs, none).count() == 2 and decontam.decontaminate(docs.limit(0), none).count() == 0
