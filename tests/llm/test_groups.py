"""Operators 3 and 5 against brute force."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from saleslattice.llm import forest, lines

SF = "/root/testdata/sf0.01"


def brute_components(rows, k):
    def shingles(t):
        w = re.findall("[^\\x20\\x09-\\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    s = {i: shingles(t) for i, t in rows}
    up = {i: i for i in s}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i in sorted(s):
        near = {}
        for g in s[i]:
            for j in by.get(g, ()):
                near[j] = near.get(j, 0) + 1
            by.setdefault(g, []).append(i)
        for j, n in near.items():
            if 100 * n >= 80 * (len(s[i]) + len(s[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s[i]), top(i)) for i in s}


@pytest.mark.parametrize("few", [4096, 0])
def test_near_dedup(spark, few, monkeypatch):
    monkeypatch.setattr(forest, "FEW", few)
    rnd = random.Random(0)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 500").collect()]
    words = [f"w{i}" for i in range(300)]
    hot = [rnd.choice(words) for _ in range(120)]
    for i in range(150):  # one large group of near copies, some too far from all others
        w = list(hot)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, "One"), (20_003, "one"), (20_004, "one two"), (20_005, "a b c d"), (20_006, " A\tb C d "), (20_007, "x " * 60_000), (20_008, "x x x x x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("a"), "comp": F.lit(1)})
    want = brute_components(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in forest.near_dedup(df, k=4).collect()}
    assert got == want
    assert forest.near_dedup(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, forest.near_dedup(odd).collect()), key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True)], key=str)


def test_ids_with_several_texts(spark):
    """One of the texts of an id makes its links; the rows have one component, each its own size."""
    near = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(5, " ".join(near)), (5, " ".join(other)), (5, None), (5, ""), (7, " ".join([*near[:-1], "x"])), (8, " ".join([*other[:-1], "x"])), (9, ""), (9, "a b c d e f"), (10, "a b c d e f"), (None, "a b c d e f")]
    for n in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = sorted((tuple(r) for r in forest.near_dedup(df).collect()), key=str)
        comp = {}
        for i, _, c, _ in got:
            comp.setdefault(i, set()).add(c)
        assert comp[5] == {5} and (comp[7], comp[8]) in (({5}, {8}), ({7}, {5})) and comp[9] == comp[10] == {9} and comp[None] == {None}
        assert sorted(r[1] for r in got if r[0] == 5) == [0, 0, 56, 56] and sorted(r[1] for r in got if r[0] == 9) == [0, 2]
    assert got == sorted((tuple(r) for r in forest.near_dedup(df.repartition(3)).collect()), key=str)


def brute_lines(rows, k):
    first = {}
    for d, t in rows:
        x = t.split("\n")
        for i in range(len(x) - k + 1):
            w = tuple(x[i : i + k])
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = {}
    for d, t in rows:
        x = t.split("\n")
        gone = {i + j for i in range(len(x) - k + 1) for j in range(k) if first[tuple(x[i : i + k])] != (d, i)}
        out[d] = (len(x), len(gone), "\n".join(y for i, y in enumerate(x) if i not in gone))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_dedup(spark, k):
    rnd = random.Random(k)
    rows = [(i, "\n".join(rnd.choice("abcd") * rnd.randrange(3) for _ in range(rnd.randrange(25)))) for i in range(150)] + [(500, ""), (501, "\n" * 300), (502, "z" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "gone": F.lit(2), "n_lines": F.lit("x")})
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.line_dedup(df, min_run=k).collect()}
    assert got == brute_lines(rows, k)


def test_line_runs(spark):
    """Runs longer than the least: maximal, over several rounds of doubling, also where they repeat within a text."""
    a = [f"line {i}" for i in range(37)]
    rows = [(1, "\n".join(a)), (2, "\n".join(["x", *a[3:30], "y", *a[30:]])), (3, "\n".join(a[5:7] + a[20:37])), (4, "\n".join(["p", "q", "p", "q", "p", "q"])), (5, "\n".join(a)), (-(1 << 63), "u\nv"), (None, "u\nv\nw"), (6, "v\nw")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc: [tuple(x) for x in r.runs] for r in lines.repeated_runs(df).collect()}
    assert got == {r.doc: [tuple(x) for x in r.runs] for r in lines.repeated_runs(df, longest=2).collect()}
    assert got == {2: [(1, 28), (29, 36)], 3: [(0, 19)], 4: [(2, 6)], 5: [(0, 37)], -(1 << 63): [(0, 2)], 6: [(0, 2)]}
    assert "Python" not in lines.line_dedup(df)._jdf.queryExecution().executedPlan().toString()


def test_line_edges(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a\nb\nc"), (3, None), (2, "x\na\nb")]
    got = sorted(map(tuple, lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "", 2, 2), (1, "", 2, 2), (None, "a\nb\nc", 3, 0), (3, None, 0, 0), (2, "x", 3, 2)], key=str)
    assert lines.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_sql(spark):
    documents = duckdb.read_parquet(f"{SF}/documents.parquet")  # noqa: F841
    want = sorted(duckdb.sql(lines.OP5_SQL).fetchall())
    assert sorted(map(tuple, lines.op5_line_dedup(spark, SF).collect())) == want and sum(r[2] for r in want)
