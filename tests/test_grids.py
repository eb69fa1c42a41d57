"""Sheets' imports, numbering, header order, dense grids, first values and sketches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from saleslattice.operators import grid as G
from saleslattice.plans import body as B
from saleslattice.plans import pivot as P
from saleslattice.sources import facts
from saleslattice.sources.fixtures import load


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_have_no_gaps(spark):
    rng = random.Random(2)
    rows = rng.sample([(s, n, "x") for s in "abcde" for n in range(300)], 900)
    df = spark.createDataFrame(rows, "sheet string, rn long, v string").repartition(7)
    got = sorted((r.number, r.sheet, r.rn) for r in G.numbered(df, ["sheet", "rn"], start=2).collect())
    assert [n for n, _, _ in got] == list(range(2, 902)) and [(s, n) for _, s, n in got] == sorted((s, n) for s, n, _ in rows)
    text = plan(G.numbered(df, ["sheet", "rn"]))
    assert "SinglePartition" not in text.split("BroadcastExchange")[0]
    assert [r.v for r in G.row_cap(G.numbered(df, ["sheet", "rn"]).where("number % 3 = 0"), 10).select(F.col("number").alias("v")).orderBy("v").collect()] == list(range(3, 31, 3))
    assert G.numbered(df.limit(0), ["sheet", "rn"]).count() == 0


def sheet(name, header, rows, first=1):
    return [(name, first + i, ["x", *cells]) for i, cells in enumerate([header, *rows])]


def test_sheets(spark):
    """Two sheets with headers, one without; ITEM NO before ITEM NAME where the sheet has it, however blank; excluded columns."""
    names = list(G.REQUIRED)
    alias = spark.createDataFrame([(n.upper().replace(".", ""), n, 1) for n in (*names, *G.ITEM, *G.EXCLUDED)], "norm_header string, canonical string, priority int")
    body = ["v"] * len(names)
    grid = [("a", 1, ["x", "Report"])] + sheet("a", [*names, "Item No", "Item Name", "FY", "Region", "Pin Code"], [[*body, " ", "n1", "1999-00", "r", "9"], [*body, "7", "n2"], body], 2)
    grid += sheet("b", [*[n.lower() for n in names], "ITEM NAME"], [[*body, "n3"], ["total"]]) + [("c", i, ["x", "no header"]) for i in range(1, 32)] + sheet("d", names, [[*body]])
    df = spark.createDataFrame(grid, "sheet string, rn long, cells array<string>")
    heads = G.first_headers(df, alias)
    assert {(r.sheet, r["head"]) for r in heads.collect()} == {("a", 2), ("b", 1)}
    assert [tuple(r) for r in G.sheet_errors(df, heads).collect()] == [("c", G.NO_HEADER)]
    with pytest.raises(ValueError, match="Invalid headers"):
        G.import_rows(df, alias)
    got = G.import_rows(df, alias, check=False).orderBy("number")
    assert [tuple(r) for r in got.select("sheet", "number", G.type_row("ITEM NAME"), G.type_row("BRANCH"), F.size(F.map_keys("at"))).collect()] == [("a", 2, None, "v", 22), ("a", 3, "7", "v", 22), ("b", 5, "n3", "v", 21)]
    assert not set(G.EXCLUDED) & {k for r in got.collect() for k in r["at"]}
    assert [r.number for r in G.import_rows(df, alias, done=2, cap=1, check=False).collect()] == [3]
    assert G.import_rows(df.where("sheet <> 'c'"), alias).count() == 3
    checked = {r.sheet: r.missing for r in G.missing_headers(G.header_cells(df).where("sheet = 'd' AND rn = 1"), alias, G.REQUIRED, (G.ITEM,)).collect()}
    assert checked == {"d": ["ITEM NAME or ITEM NO"]}


def test_header_order(spark):
    def order(labels, fields, desc=False):
        df = spark.createDataFrame([(x if isinstance(x, list) else [x],) for x in labels], "labels array<string>")
        return ["||".join(r["labels"]) for r in P.sort_headers(df, fields, desc).orderBy("place").collect()]

    texts = ["zebra", "Émile", "emile 10", "Emile 9", "(blank)", "apple", "Äpfel", "", "item 12b", "ITEM 2c", "item 2b"]
    rising = order(texts, ["brand"])
    assert rising == ["Äpfel", "apple", "Émile", "Emile 9", "emile 10", "item 2b", "ITEM 2c", "item 12b", "zebra", "", "(blank)"]
    assert order(texts, ["brand"], True) == rising[::-1]
    assert order(["Jan-26", "Apr-25", "(blank)", "whenever", "December/2024"], ["month"]) == ["December/2024", "Apr-25", "Jan-26", "whenever", "(blank)"]
    assert order(["MAR", "APR", "JAN"], ["mmm"]) == ["JAN", "MAR", "APR"]
    assert order(["2024-25", "1999-00", "new"], ["fy"]) == ["1999-00", "2024-25", "new"]
    assert order(["2024-03-01", "2023-12-31", "soon"], ["bill_date"]) == ["2023-12-31", "2024-03-01", "soon"]
    assert order(["2024-25", "1999-00"], ["brand"]) == ["1999-00", "2024-25"]  # as texts
    assert order([["b", "Jan-26"], ["b", "Apr-25"], ["A", "Jan-26"]], ["brand", "month"]) == ["A||Jan-26", "b||Apr-25", "b||Jan-26"]
    assert order(["Jan-26", "Apr-25"], ["brand"]) == ["Apr-25", "Jan-26"] and order(["Apr-25", "Dec-24"], ["brand"]) == ["Apr-25", "Dec-24"]


def test_dense_grid(spark):
    rows = [("a", "x", 1.0), ("a", "z", 2.0), ("b", "y", -3.0), (None, "x", 4.0), ("b", "y", 5.0)]
    df = spark.createDataFrame([(i, *r, "br") for i, r in enumerate(rows)], "id int, state string, brand string, net_amount double, branch string")
    cfg = P.config(["state"], ["brand"], [("net_amount", "sum"), ("net_amount", "min"), ("id", "count")])
    heads, grid = B.dense_grid(df, cfg)
    assert [(r.place, r.col_labels) for r in heads.orderBy("place").collect()] == [(1, ["x"]), (2, ["y"]), (3, ["z"])]
    got = {r.row_labels[0]: ([float(x) for x in r.sum_net_amount], [None if x is None else float(x) for x in r.min_net_amount], r.count_id) for r in grid.collect()}
    assert got == {"a": ([1, 0, 2], [1, None, 2], [1, 0, 1]), "b": ([0, 2, 0], [None, -3, None], [0, 2, 0]), "(blank)": ([4, 0, 0], [4, None, None], [1, 0, 0])}
    text = plan(grid)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    heads, grid = B.dense_grid(df, cfg, 18)  # two columns of three rows and three metrics
    assert heads.count() == 2 and {len(r.count_id) for r in grid.collect()} == {2} and grid.count() == 3
    for rows_, cols in ((["state"], []), ([], ["brand"]), ([], [])):
        heads, grid = B.dense_grid(df, P.config(rows_, cols, [("id", "count")]))
        assert sum(map(sum, (r.count_id for r in grid.collect()))) == 5
        assert ["(all)"] in [r.col_labels for r in heads.collect()] or cols


def test_first_values(spark):
    rng = random.Random(4)
    values = {f: list({"".join(rng.choice("aBcDéZ09 ") for _ in range(6)).strip() for _ in range(n)} - {""}) for f, n in (("x", 3500), ("y", 900), ("z", 1001))}
    df = spark.createDataFrame(list(itertools.zip_longest(*values.values())), "x string, y string, z string").repartition(4)
    for limit in (50, 1000, 1500, 2000):
        got: dict[str, list[str]] = {}
        for r in P.distinct_values_batch(df, ["x", "y", "z"], limit).collect():
            got.setdefault(r.field, []).append(r.value)
        for f, every in values.items():
            want = sorted(every, key=lambda v: (v.lower().encode(), v.encode()))[:limit]
            assert sorted(got[f], key=lambda v: (v.lower().encode(), v.encode())) == want
    text = plan(P.distinct_values_batch(df, ["x", "y", "z"], 2000))
    assert text.count("WindowGroupLimit") >= 4  # in partitions and after, in both steps


def test_sketches(spark, sf, tmp_path):
    """Cardinalities from sketches of parts, near the exact ones; the fact is not read."""
    fact, fields = load(spark, sf), ["branch", "to_party_name", "item_no", "bill_no"]
    at = str(tmp_path / "sketches")
    P.sketch_axes(fact, fields, ["state"]).write.parquet(at)
    est = P.estimated_cardinality(spark.read.parquet(at), fields)
    exact = P.axis_cardinality(fact, fields).first()
    got = est.first()
    for f in fields:
        assert abs(got[f] - exact[f]) <= max(2, 5 * 1.04 / 64 * exact[f]), (f, got[f], exact[f])
    assert "lineitem" not in plan(est) and got["cells"] > 0
    assert P.estimated_cardinality(spark.read.parquet(at).limit(0), fields).first()["branch"] == 0


def test_keys_and_totals(spark, sf):
    cfg = P.config(["state", "brand"], ["fy"], [("id", "count")])
    assert P.cell_keys(cfg, "NATION_7||IC", "1999-00") == {"state": "NATION_7", "brand": "IC", "fy": "1999-00"}
    assert P.cell_keys(cfg, "NATION_7", "") == {"state": "NATION_7", "brand": "", "fy": ""}
    fact, keys = load(spark, sf), {"state": "(all)", "brand": "IC"}
    total = P.drilldown_total(fact, cfg, keys).first().total
    assert total > 200 and P.drilldown(fact, cfg, keys).count() == 200 and P.drilldown(fact, cfg, keys, total - 3).count() == 3


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("j", 12, 'say "no"', '{"a":1}'), ("j", 3, None, None), ("k", 1, "x", "y")], "job_id string, row_number int, error_message string, row_data string")
    facts.sink_lines(facts.export_rejects(rows, "j"), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text == 'Row Number,Error Message,Row Data\n"3","",""\n"12","say ""no""","{""a"":1}"\n'
    fact = spark.createDataFrame([(2, "b,1", " 1999-00", "Apr-99", 5.5), (1, "a", "1999-00", "May-99", 1.0), (3, "c", "2000-01", "Apr-99", 1.0)], "id long, branch string, fy string, month string, net_amount double")
    facts.sink_period_report(facts.export_period(fact, "1999-00"), str(tmp_path / "p"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*"))).splitlines()
    assert lines[0].startswith("BRANCH,FY,MONTH,MMM,REGION") and len(lines[0].split(",")) == 36 and [x[:20] for x in lines[1:]] == ["a,1999-00,May-99,,,,", '"b,1", 1999-00,Apr-9'[:20]]
    assert facts.export_period(fact, "1999-00", "May-99").count() == 1


def test_regions(spark):
    states = spark.createDataFrame([("S1", 1), ("S2", 2)], "state string, region_id int")
    regions = spark.createDataFrame([(1, "East"), (2, "West")], "id int, region string")
    blank = spark.createDataFrame([("S1", " ")], "State string, Region string")
    full = spark.createDataFrame([("S9", "North")], "STATE string, region string")
    want = [("S1", "East"), ("S2", "West")]
    assert sorted(map(tuple, facts.scan_regions(None, states, regions).collect())) == want == sorted(map(tuple, facts.scan_regions(blank, states, regions).collect()))
    assert [tuple(r) for r in facts.scan_regions(full, states, regions).collect()] == [("S9", "North")]
    with pytest.raises(ValueError):
        facts.scan_regions(None)
