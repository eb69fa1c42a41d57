"""Unit vectors, sources, streams and invariants of the sales model."""

import pytest
from pyspark.sql import functions as F

from saleslattice.functions import exprs as X
from saleslattice.operators import filters as W
from saleslattice.operators import rollups as R
from saleslattice.plans import body as B
from saleslattice.plans import pivot as P
from saleslattice.plans.queries import _masters, enriched
from saleslattice.sources import facts, scratch
from saleslattice.sources.fixtures import load
from saleslattice.streaming import ingest


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(c) for c in df.columns)).alias("x")).first().x


def test_vectors(spark):
    assert one(spark, lambda c: X.fy_of_date(c.cast("date")), "2025-04-01") == "2025-26"
    assert one(spark, lambda c: X.fy_of_date(c.cast("date")), "2025-03-31") == "2024-25"
    assert one(spark, X.normalize_party, "A–B ") == "a - b"
    assert one(spark, X.normalize_party, "X" + chr(160) + " Y") == "x y"
    assert one(spark, X.party_alias_keys, "M/S. ABC TRADERS") == "abc traders" and one(spark, X.party_alias_keys, "MSR CO") == "r co"
    assert [one(spark, X.goods_type, v) for v in ("'MID/1", "ACS1", "SO1", " ")] == ["MID", "ACC", "Fresh", None]
    assert one(spark, X.item_with_shade, "6902", "5") == "6902 5" and one(spark, X.item_with_shade, " ", None) is None
    assert [one(spark, X.money_cell, v) for v in ("₹1,234.50", "N/A", "1-2")] == [1234.5, 0.0, None]
    for v in ("26-01-2025", "26/01/2025", "20250126", "45683"):
        assert str(one(spark, X.parse_date_cell, v)) == "2025-01-26"
    assert one(spark, X.parse_date_cell, "27") is None
    assert one(spark, lambda c: X.round_half_up(c), "-2.5") == -3 and one(spark, lambda c: X.format_indian(c), "200690602") == "20,06,90,602"
    df = spark.createDataFrame([("1,200",), ("12.",), ("10 PCS",)], "units_pack string")
    assert [r[0] for r in df.select(X.fact_numeric("units_pack").cast("double")).collect()] == [1200.0, 12.0, None]
    assert one(spark, X.derive_group_name, "ABC MILLS -  DELHI") == "ABC MILLS"


def test_header_order(spark):
    df = spark.createDataFrame([("(blank)",), ("Jan-26",), ("Apr-25",)], "l string")
    assert [r.l for r in df.orderBy(P.header_key(F.col("l"))).collect()] == ["Apr-25", "Jan-26", "(blank)"]


def test_totals_agree(spark, sf):
    got = P.pivot(load(spark, sf), P.config(["state", "brand"], ["fy"], [("net_amount", "sum")], subtotals=["state"])).groupBy("kind").agg(F.sum("sum_net_amount")).collect()
    assert len(got) == 6 and len({v for _, v in got}) == 1


def test_fact_round_trip(spark, sf, tmp_path):
    fact = enriched(spark, sf)
    facts.sink_fact(fact, str(tmp_path / "f"))
    back = facts.scan_fact(spark, str(tmp_path / "f"))
    assert back.count() == fact.count() and "norm_party" in back.columns
    part = facts.scan_fact(spark, str(tmp_path / "f"), "1998-01-01", "1998-03-31")
    assert part.count() == fact.where("bill_date BETWEEN '1998-01-01' AND '1998-03-31'").count()
    assert facts.export_period(fact, "1999-00").count() == fact.where("fy = '1999-00'").count()


def test_grid(spark):
    rows = [("s", 1, ["", "Report"]), ("s", 2, ["", "Bill No.", "NET amount"]), ("s", 3, ["", "B1", "5"]), ("s", 4, ["", "B2"]), ("s", 5, ["", "total", "5"])]
    rows += [("none", i, ["", "x"]) for i in range(31)] + [("few", i, ["", "x"]) for i in range(30)]
    g = facts.scan_grid(spark.createDataFrame(rows, "sheet string, rn long, cells array<string>"), ["BILL NO", "NET AMOUNT"])
    assert [(r.sheet, r.error) for r in g.where("error IS NOT NULL").collect()] == [("none", "required header row not found")]
    g = g.where("error IS NULL")
    got = g.orderBy("rn").select("rn", facts.cell("BILL NO").alias("b"), facts.cell("NET AMOUNT").alias("n")).collect()
    assert [tuple(r) for r in got] == [(3, "B1", "5"), (4, "B2", None)]
    bad = facts.rejects(g.select("rn", facts.cell("BILL NO").alias("bill_no"), F.lit(None).cast("string").alias("bill_date"), F.lit("i").alias("item_no"), F.lit('x"y').alias("to_party_name"), F.lit("bad").alias("error_message")), "j")
    assert facts.export_rejects(bad, "j").orderBy("part", "key").collect()[1].line.startswith('"3","bad","{""bill_no"":""B1""')


def test_streams(spark, sf, tmp_path):
    sales = load(spark, sf)
    sales.repartition(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds no new files
        ingest.ingest_stream(spark, sales.schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c1"), _masters(spark, sf)).awaitTermination()
        ingest.rollup_stream(spark, sales.schema, str(tmp_path / "in"), str(tmp_path / "roll"), str(tmp_path / "c2"), "state_month").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == sales.count()
    want = sorted(map(str, R.rollup(sales, "state_month").collect()))
    assert sorted(map(str, ingest.merged(spark, str(tmp_path / "roll")).select("state", "bill_month", *R.SUMS.values(), "fact_row_count").collect())) == want


def test_csv_file(spark, tmp_path):
    """An exported pivot as it lies on disk: byte order mark, level and metric lines, rows in order, footer, quotes."""
    df = spark.createDataFrame([(1, "b,1", "x", "m", None, 1234567.5), (2, "a", "x", "m", None, -1000.0), (3, "a", "y", "n", None, 5.4)], "id int, state string, brand string, city string, branch string, net_amount double")
    cfg = P.config(["state"], ["brand", "city"], [("net_amount", "sum"), ("id", "count")])
    facts.sink_lines(B.export_pivot_csv(df, cfg, [("x", "m"), ("y", "n")]), str(tmp_path / "out"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    want = 'ROWS,X,X,Y,Y,,\nSTATE,M,M,N,N,GRAND TOTAL,GRAND TOTAL\n,SUM net_amount,COUNT id,SUM net_amount,COUNT id,SUM net_amount,COUNT id\na,"-1,000",1,5,1,-995,2\n"b,1","12,34,568",1,,,"12,34,568",1\nGRAND TOTAL,"12,33,568",2,5,1,"12,33,573",3\n'
    assert raw.decode("utf-8-sig") == want and raw.startswith(b"\xef\xbb\xbf")


def test_values_of_many_fields(spark):
    df = spark.createDataFrame([("a",)], "x string")
    for bad in ([], [f"f{i}" for i in range(25)]):
        with pytest.raises(ValueError):
            P.distinct_values_batch(df, bad)
    assert {tuple(r) for r in P.distinct_values_batch(df, ["x", "z", "x"]).collect()} == {("x", "a", None), ("z", None, "Invalid filter field")}


def test_shared_folder_is_named(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        scratch.folder(Session())


def test_fy_axis_of_month_texts(spark):
    """The first of fy, bill_date and a month's label that tells a year; labels of another form tell none."""
    cases = {"Apr-01": "2001-02", "mar-2000": "1999-00", " Jan / 99 ": "2098-99", "Sept-125": "2025-26", "April/0024": "24-25", "Foo-12": None, "\tApr-25": None, "Apr-25\n": "2025-26", "Ma-12": None, "Mar-12345": None, "Mar_20": None, "Mar-1": None, "": None, None: None}
    rows = [(i, None, None, m) for i, m in enumerate(cases)] + [(90, " ", "2000-03-31", "Apr-01"), (91, "own", "2000-03-31", None), (92, None, "2000-04-01", None), (93, None, "1999-12-31", "x"), (94, None, "0001-01-01", None), (95, None, "9999-12-31", None)]
    df = spark.createDataFrame(rows, "i int, fy string, d string, month string").withColumn("bill_date", F.col("d").cast("date"))
    got = [r.v for r in df.select("i", X.fy_axis().alias("v")).orderBy("i").collect()]
    assert got == [*cases.values(), "1999-00", "own", "2000-01", "1999-00", "0-01", "9999-00"]


def test_total_rows_of_pivots(spark):
    branches = ["total", " Total ", "GRAND TOTAL", "xgrand totalx", "GrandTotal", "totals", "grand  total", "total\n", "a\nGrand Total", "", None]
    df = spark.createDataFrame(list(enumerate(branches)), "i int, branch string")
    assert [r.i for r in df.where(W.not_total_pivot()).orderBy("i").collect()] == [5, 6, 7, 9, 10]
