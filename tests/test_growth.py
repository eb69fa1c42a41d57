"""Shapes of plans and files on which the growth of queries depends."""

import glob
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from saleslattice.operators import grid as G
from saleslattice.operators import lookups as L
from saleslattice.operators import maintain as M
from saleslattice.operators import rollups as R
from saleslattice.plans import pivot as P
from saleslattice.plans.catalog import QUERIES
from saleslattice.plans.queries import _masters
from saleslattice.sources import facts, fixtures, stored
from saleslattice.sources.fixtures import TABLES, load


@pytest.fixture
def shuffled(spark):
    """A session that broadcasts only what is said to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins(df):
    return [line for line in plan(df).splitlines() if "Join" in line]


def refuse(*_, **__):
    raise AssertionError("not to be called")


@pytest.mark.parametrize("name", ["scan_grid", "column_plan", "win_resume_skip"])
def test_sheets_are_read_whole(spark, sf, monkeypatch, name):
    monkeypatch.setattr(G, "row_cap", refuse)
    assert QUERIES[name](spark, sf).count() > 0


def test_sheets_are_not_shuffled_by_name(shuffled):
    grid = shuffled.range(100).select(F.lit("one").alias("sheet"), F.col("id").alias("rn"), F.array(F.lit("x")).alias("cells"))
    df = G.drop_footer(grid)
    assert df.count() == 99 and "SortMergeJoin" not in plan(df)


def test_row_cap_counts_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "numbered", refuse)
    monkeypatch.setattr(G, "BLOCK", 64)
    df = spark.range(1000).select((F.col("id") * 3).alias("number")).repartition(5)
    for n in (-1, 0, 1, 21, 22, 500, 1000, 2000):
        assert sorted(r.number for r in G.row_cap(df, n).collect()) == [3 * i for i in range(max(0, min(n, 1000)))]


def test_shards_are_folders(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("rn"), F.lit("v").alias("v")).repartition(8)
    facts.sink_sharded_csv(df, 4, str(tmp_path / "s"))
    assert len(glob.glob(str(tmp_path / "s" / "shard=*" / "part-*"))) == 32
    got = facts.read_shards(spark, str(tmp_path / "s"), "rn bigint, v string").groupBy("shard").agg(F.count("bad").alias("bad"), F.count_distinct("rn").alias("n")).collect()
    assert {r.shard for r in got} == set("0123") and sum(r.n for r in got) == 1000 and min(r.n for r in got) > 200 and not any(r.bad for r in got)
    spark.createDataFrame([(1, "v")], "rn long, v string").coalesce(1).write.option("header", True).csv(str(tmp_path / "plain"))
    assert facts.read_shards(spark, str(tmp_path / "plain"), "rn bigint, v string").first().shard.startswith("part-")


def test_sink_does_not_shuffle(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "hint", refuse)
    facts.sink_fact(load(spark, sf), at := str(tmp_path / "f"))
    facts.sink_fact(load(spark, sf), at)
    assert facts.approx_count(spark, at).first().n == 2 * load(spark, sf).count()


def test_stream_input_stays_dealt(spark, sf, monkeypatch):
    asked, real = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: (asked.append(a), real(self, *a))[1])
    monkeypatch.setattr(DataFrame, "coalesce", refuse)
    assert QUERIES["rollup_stream"](spark, sf).count() > 0 and (2,) not in asked


def test_sums_of_keys(spark):
    df = spark.sql("SELECT id DIV 3 AS k, id, CAST(IF(id < 3, NULL, -1.5) AS DECIMAL(15,4)) AS sl_qty, CAST(2 AS DECIMAL(15,4)) AS gross_amount, 0.5D AS amount_before_tax, CAST(3 AS DECIMAL(15,4)) AS net_amount FROM range(6)")
    got = R.rollup(df, "all_dims")
    assert "sum(net_amount" not in plan(got) and got.schema["sum_net_amount"].dataType.simpleString() == "decimal(25,4)"
    assert sorted(tuple(map(str, r)) for r in got.select("k", "sum_sl_qty", "sum_gross_amount", "sum_amount_before_tax", "sum_net_amount", "fact_row_count").collect()) == [("0", "None", "6.0000", "1.5", "9.0000", "3"), ("1", "-4.5000", "6.0000", "1.5", "9.0000", "3")]


@pytest.mark.parametrize("name", ["join_freshness", "check_rollup_fresh"])
def test_checks_read_the_fact_once(spark, sf, name):
    assert "lineitem" not in plan(QUERIES[name](spark, sf))


def test_enrichment_joins_orders_by_party(shuffled, sf):
    """The fact meets its party's orders with all else of the party, and is not shuffled again by brand and year."""
    keys = joins(L.enrich_fact(load(shuffled, sf), _masters(shuffled, sf)))
    assert not any("_xb" in k for k in keys) and sum("[to_party_name" in k for k in keys) == 1


@pytest.mark.parametrize("make", [lambda s, d: M.backfill_so_type(load(s, d), load(s, d, "fx_so_master")), lambda s, d: L.lookup_customer_type(load(s, d), load(s, d, "fx_customer_type_master"))])
def test_keys_are_taken_of_names(shuffled, sf, make):
    """Keys are columns before a sort compares them, and the fact is joined once, by the name as it is."""
    keys = joins(make(shuffled, sf))
    assert not any("regexp_replace" in k for k in keys) and sum("[to_party_name" in k for k in keys) == 1


def test_lists_of_the_fact_read_it_once(spark, sf, tmp_path, monkeypatch):
    """Values of several fields of the fact come from one pass over it."""
    seen, real = [], P.distinct_values
    monkeypatch.setattr(P, "distinct_values", lambda df, f, *a: seen.append((f, "lineitem" in plan(df))) or real(df, f, *a))
    got = QUERIES["distinct_from_rollup"](spark, sf)
    assert "lineitem" not in plan(got) and seen == [("branch", False), ("state", False)]
    df = spark.createDataFrame([(" b", None), ("B", "x"), ("", "x"), ("a", " ")], "city string, branch string")
    lists = P.distinct_lists(df, ["city", "branch"], str(tmp_path / "v"))
    assert {f: [r.value for r in x.collect()] for f, x in lists.items()} == {f: [r.value for r in real(df, f).collect()] for f in lists}


@pytest.mark.parametrize("broadcast", ["-1", "100000000"])
@pytest.mark.parametrize("name", ["pivot_subtotals", "pivot_totals_onepass", "pivot_row_totals", "pivot_column_totals", "pivot_grand_total", "pivot_groupby"])
def test_pivots_are_compiled(shuffled, sf, name, broadcast):
    """No method that Spark generates is over 8000 bytes, which the JVM would interpret for each row."""
    shuffled.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    shuffled.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        physical = QUERIES[name](shuffled, sf)._jdf.queryExecution().executedPlan()
    finally:
        shuffled.conf.unset("spark.sql.adaptive.enabled")
    debug = getattr(getattr(shuffled._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(physical)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and 0 < max(sizes) < 8000


def test_fy_labels_are_made_of_groups(spark, sf):
    """Rows are grouped by what tells the fiscal year; its label is put together above the first aggregate."""
    text = plan(QUERIES["pivot_subtotals"](spark, sf))
    assert "lpad" not in text[text.index("partial_count(1)") :] and "add_months" in text


@pytest.fixture(scope="module")
def large_keys(spark, sf, tmp_path_factory):
    """The tables with order keys as on 360 times sf0.1, whose ids are over 63 bits."""
    top, up = tmp_path_factory.mktemp("keys"), {"order": 53_850_000, "cust": 5_385_000, "part": 7_180_000, "supp": 359_000}
    for t in TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        df.withColumns({c: F.col(c) + n for c in df.columns for k, n in up.items() if c.endswith(f"_{k}key")}).write.parquet(f"{top}/{t}.parquet")
    return str(top)


def test_ids_beyond_bigint(spark, sf, large_keys, tmp_path):
    """Ids are exact where they are larger than a bigint, and bigint where they are not."""
    own = ((F.col("l_orderkey").cast("decimal(38,0)") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    for d, kind in ((large_keys, "decimal(38,0)"), (sf, "bigint")):
        lines = spark.read.parquet(f"{d}/lineitem.parquet")
        got = load(spark, d)
        assert got.schema["id"].dataType.simpleString() == kind
        assert sorted(int(r[0]) for r in got.select("id").collect()) == sorted(int(r[0]) * 100 + int(r[1]) for r in lines.select(own, "l_quantity").collect())
    facts.sink_period_report(facts.export_period(load(spark, large_keys), "1999-00"), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 1 + load(spark, sf).where("fy = '1999-00'").count()


@pytest.mark.parametrize("name", ["enrich_fact", "load_sharded_csv", "delete_range", "ingest_stream", "sink_sharded_csv", "sink_fact", "approx_count", "scan_fact", "page_offset", "export_rejects"])
def test_large_keys(spark, large_keys, name):
    assert QUERIES[name](spark, large_keys).collect()


def below(text, node):
    """The lines of a plan under the first node that has a text."""
    lines = text.splitlines()
    i = next(i for i, line in enumerate(lines) if node in line)
    deep = lines[i].index(node)
    end = next((j for j in range(i + 1, len(lines)) if len(lines[j]) - len(lines[j].lstrip(" :+-|")) <= deep - 2), len(lines))
    return "\n".join(lines[i:end])


def test_lines_are_shuffled_twice(shuffled, sf, monkeypatch):
    """Orders meet their customers before lines do; the rows are those of the view as written."""
    got = load(shuffled, sf)
    assert "l_orderkey" not in below(plan(got), "Exchange hashpartitioning(o_custkey")
    monkeypatch.setattr(fixtures, "JOINS", ("", ""))
    want = load(shuffled, sf)
    assert "l_orderkey" in below(plan(want), "Exchange hashpartitioning(o_custkey") and got.schema == want.schema
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rows_without_repeats_stay(spark, sf):
    """Rows are shuffled only where another has their hash."""
    assert "Exchange" not in plan(R.rollup(load(spark, sf), "all_dims"))


@pytest.mark.parametrize("most", [0, 2, 2_000_000])
@pytest.mark.parametrize("repeats", [0, 1, 90])
def test_groups_of_one_row(spark, monkeypatch, repeats, most):
    """Totals are those of a plain aggregate, whichever rows are shuffled: nulls, negative zeros, columns without a hash, sums of all kinds."""
    monkeypatch.setattr(R, "MOST", most)
    rows = spark.sql("SELECT IF(id % 10 = 0, NULL, CAST(id AS STRING)) AS s, IF(id % 10 = 0, CAST(id AS STRING), NULL) AS t, array(id) AS a, IF(id % 2 = 0, -0.0D, 0.0D) AS z, CAST(id AS DECIMAL(15,4)) AS d, id / 4 AS x, CAST(id AS INT) AS n, 1L AS k FROM range(100)")
    df = rows.unionByName(rows.limit(repeats).withColumn("z", -F.col("z"))).repartition(3)
    sums, by = {"d": "sum_d", "x": "sum_x", "n": "sum_n"}, ["s", "t", "a", "z"]
    for count in (None, "k"):
        got, want = R.grouped(df, by, sums, count), R._totals(df, by, sums, count)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
        assert sorted(map(str, got.withColumn("z", F.col("z") + 0.0).collect())) == sorted(map(str, want.withColumn("z", F.col("z") + 0.0).collect()))


def test_refresh_leaves_only_rollups(spark, sf, tmp_path):
    at = R.refresh(load(spark, sf), str(tmp_path / "r"), ("all_dims", "branch_brand"))
    assert sorted(p.name for p in Path(at).iterdir()) == ["all_dims", "base", "branch_brand", "names"]


def test_checked_rollups_are_removed(spark, sf, monkeypatch):
    made, real = [], R.refresh
    monkeypatch.setattr(R, "refresh", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    assert QUERIES["check_rollup_fresh"](spark, sf).count() == 3 and len(made) == 2 and not any(stored.exists(spark, at) for at in made)


def test_stored_rows_are_compiled(shuffled, sf):
    """The method of a sales line that is stored is under 8000 bytes, which the JVM would interpret."""
    shuffled.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        physical = load(shuffled, sf).drop("id")._jdf.queryExecution().executedPlan()
    finally:
        shuffled.conf.unset("spark.sql.adaptive.enabled")
    stages = getattr(getattr(shuffled._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(physical)
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
