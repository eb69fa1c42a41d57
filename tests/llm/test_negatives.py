"""Hard negatives against brute force: crowds of equal vectors, ties, odd rows, several lengths and blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslattice.llm import negatives as N

SCHEMA = "label long, vec_id long, embedding array<float>, score string"


def whole(x, scale=256.0):
    return [math.floor(scale * float(np.float32(v))) for v in x]


def brute(rows, positives=5, negatives=3, low=50, high=95):
    good = [(i, y, whole(v)) for y, i, v, _ in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, la, va in good:
        if a % 50:
            continue
        of = sorted(((-sum(p * q for p, q in zip(va, v, strict=True)), i, y) for i, y, v in good if i != a and len(v) == len(va)))
        for s, p, _ in [x for x in of if x[2] == la][:positives]:
            fit = [x for x in of if x[2] != la and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def run(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = N.hard_negatives(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.fixture
def small(monkeypatch):
    for name, n in (("BLOCK", 16), ("BUNDLE", 2), ("PACK", 3), ("PAGE", 3)):
        monkeypatch.setattr(N, name, n)


def rows_of(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third of all rows is one vector
    return [(int(rng.integers(0, 3)), i, x[i].tolist(), "x") for i in range(n)]


def test_blocks_and_crowds(spark, small):
    rows = rows_of(500, 8)
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 100
    stored = N.blocks(N.vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", F.lit(True), 256.0))
    lens = [len(r.ids) // 8 for r in stored.where("kind = 0").collect()]
    assert sum(lens) == 500 and max(lens) == 16 and stored.where("kind = 2").count() > 3
    assert stored.select("kind", "unit", "block").distinct().count() == stored.count()


def test_odd_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(120, 3)
    rows += [(0, None, [1.0, 0.0, 0.0], ""), (None, 150, [1.0, 0.0, 0.0], ""), (0, 200, None, ""), (0, 250, [1.0, None, 0.0], ""), (1, 300, [nan, 0.0, 0.0], ""), (1, 350, [0.0, inf, 0.0], "")]
    rows += [(0, 400, [], ""), (0, 401, [], ""), (1, 402, [], ""), (2, 450, [2.0], ""), (2, 451, [1.0], ""), (1, 452, [0.75], ""), (0, 453, [0.75], ""), (0, 3, [5.0, 5.0, 5.0], ""), (1, 3, [4.0, 4.0, 4.0], "")]
    rows += [(0, -50, [3.0, 3.0, 3.0], ""), (0, 500, [1e6, 2e6, 3e6], ""), (1, 501, [1e6, 1e6, 3e6], ""), (0, 502, [1e6, 2e6, 3e6], "")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[0] == 400 for r in got) and any(r[0] == 450 for r in got) and any(r[0] == -50 for r in got)


def test_empty_and_repeats(spark):
    assert run(spark, []) == []
    rows = [(0, 0, [1.0, 0.0], ""), (0, 1, [1.0, 0.0], ""), (1, 2, [0.75, 0.0], ""), (1, 2, [0.75, 0.0], "")]
    assert run(spark, rows) == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 2, 65536, 49152)]


def test_curve_and_bounds():
    side = 1 << 3
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    at = N.hilbert(cells, 3)
    assert sorted(at.tolist()) == list(range(side**3))
    walk = cells[np.argsort(at)]
    assert (abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # neighbours on the curve are neighbours on the grid
    rng = np.random.default_rng(1)
    x, y = rng.integers(-300, 300, (7, 5)).astype(float), rng.integers(-300, 300, (40, 5)).astype(float)
    least, most = N.bounds(x, y.min(0)[None], y.max(0)[None])
    s = N.scores(x, y)
    assert (least[:, 0] <= s.min(1)).all() and (most[:, 0] >= s.max(1)).all()
    assert N.scores(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0]])).tolist() == [[2**60 + 3]]


def test_query(spark, sf):
    import duckdb

    from saleslattice.llm import oracle_sql, queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rel = con.sql(oracle_sql()["op11_hard_negatives"])
    got = queries()["op11_hard_negatives"](spark, sf).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall()) and got
