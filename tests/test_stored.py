"""Stored tables: partition deletes, bucketed merges, rollup versions and stream parts."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from saleslattice.operators import lookups as L
from saleslattice.operators import maintain as M
from saleslattice.operators import rollups as R
from saleslattice.plans import pivot as P
from saleslattice.sources import facts, stored
from saleslattice.sources.fixtures import load
from saleslattice.streaming import ingest


def files(path):
    return {f.removeprefix(str(path)): (os.stat(f).st_ino, os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_delete_range(spark, sf, tmp_path):
    at = str(tmp_path / "fact")
    fact = load(spark, sf).withColumn("bill_date", F.when(F.col("sl_qty") < 25, F.add_months("bill_date", 12 * 27)).otherwise(F.col("bill_date")))
    facts.sink_fact(fact, at)
    before = files(at)
    years = {f.split("/")[1] for f in before}
    assert len(years) > 3
    # the whole of 2021-22 and a part of 2022-23
    gone = stored.delete_range(spark, at, "2021-04-01", "2022-05-31")
    want = {(r.fy_part, r.n) for r in fact.where("bill_date BETWEEN '2021-04-01' AND '2022-05-31'").groupBy(facts.fy_part(F.col("bill_date")).alias("fy_part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {tuple(r) for r in gone.collect()} == want and {p for p, _ in want} == {"2021-22", "2022-23"}
    after = files(at)
    kept = {f: x for f, x in before.items() if "=2021-22" not in f and "=2022-23" not in f}
    assert kept.items() <= after.items() and not [f for f in after if "=2021-22" in f]
    back = spark.read.parquet(at)
    assert sorted(r[0] for r in back.select("id").collect()) == sorted(r[0] for r in fact.where("NOT coalesce(bill_date BETWEEN '2021-04-01' AND '2022-05-31', false)").select("id").collect())
    assert stored.delete_range(spark, at, "2021-04-01", "2022-05-31").collect() == [] and files(at) == after  # again: nothing


def test_purge(spark, tmp_path):
    rows = [(1, "completed", "2024-01-15"), (2, "failed", "2024-01-20"), (3, "running", "2024-01-20"), (4, "completed", "2024-06-01"), (5, "completed", None), (6, "cancelled", "2023-12-31"), (7, "failed", "2024-02-10")]
    df = spark.createDataFrame(rows, "id long, status string, ended string").withColumn("ended", F.col("ended").cast("date"))
    stored.sink_ledger(df, at := str(tmp_path / "ledger"))
    before = files(at)
    assert {tuple(r) for r in stored.purge_jobs(spark, at, "2024-05-01", 90).collect()} == {("2024-01", 2), ("2023-12", 1)}
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [3, 4, 5, 7]
    same = {f: x for f, x in before.items() if "2024-06" in f or "2024-02" in f or "__open__" in f}
    assert same.items() <= files(at).items() and len(same) == 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyed_merge(spark, tmp_path):
    """Duplicates in the upload, blank values, new keys; only the upload is shuffled."""
    master = spark.createDataFrame([("P1", "IC", "2023-24", "OLD", "A1"), ("P2", "IC", "2023-24", "OLD", None), ("P1", "RF", "2023-24", None, "A3")], "party_name string, brand string, fy string, type_of_order string, so_agent_name string")
    upload = [(1, " p1", "ic", "2023-24 ", "one", " "), (2, "P1", "IC", "2023-24", "two", "b1"), (3, "p1 ", "IC", "2023-24", " ", None), (1, "p9", "IC", "2024-25", "new", "x"), (2, "P9", "ic", "2024-25", None, None), (5, " ", "IC", "2024-25", "none", None), (6, "p8", None, "2024-25", "none", None)]
    rows = spark.createDataFrame(upload, "seq long, party_name string, brand string, fy string, type_of_order string, so_agent_name string")
    want = [("P1", "IC", "2023-24", "two", "B1"), ("P1", "RF", "2023-24", None, "A3"), ("P2", "IC", "2023-24", "OLD", None), ("P9", "IC", "2024-25", "new", "X")]
    stored.store_bucketed(master, "test_so_master", M.SO_KEY, 4, str(tmp_path / "so"))
    for m, n in ((master, None), (spark.table("test_so_master"), 4)):
        got = M.upsert_so_master(m, rows.repartition(3), "seq", n)
        assert sorted(map(tuple, got.select(master.columns).collect()), key=str) == sorted(want, key=str)
    text = plan(got)
    side = text[text.index("SortMergeJoin") : text.index("FileScan")]
    assert "Exchange" not in side and "Bucketed: true" in text, text
    spark.sql("DROP TABLE test_so_master")


def test_fold_and_upsert(spark):
    target = spark.createDataFrame([(1, "a", "k"), (None, "n", "k")], "id long, v string, w string")
    rows = spark.createDataFrame([(2, 1, "c", None), (1, 1, "b", "x"), (1, None, "m", None), (1, 7, None, "y"), (2, 7, "z", None)], "seq long, id long, v string, w string")
    got = M.upsert(target, rows.repartition(4), ["id"], "seq").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "c", "x"), (None, "m", "k"), (7, "z", "y")], key=str)


def test_party_grouping(spark):
    master = spark.createDataFrame([(1, "Abc ", "g"), (2, "abc", "h"), (3, "Def", "i")], "id long, to_party_name string, party_grouped string")
    rows = spark.createDataFrame([(1, "ABC", "n1"), (2, "abc", "n2"), (3, " ", "x"), (4, "New", None)], "seq long, to_party_name string, party_grouped string")
    got = M.upsert_party_grouping(master, rows, "seq")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "Abc ", "g"), (3, "Def", "i"), (None, "ABC", "n1"), (None, "abc", "n2"), (None, "New", "New")], key=str)


@pytest.fixture(scope="module")
def rolled(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rollups"))
    agents = load(spark, sf, "fx_agent_name_master")
    fact = L.lookup_agent(load(spark, sf), agents)
    R.refresh(fact, at)
    return fact, at


def test_nine_rollups(spark, rolled):
    fact, at = rolled
    now = stored.current(spark, at)
    assert R.stored_names(spark, now) == {*R.ROLLUPS, "all_dims"}
    for name in (*R.ROLLUPS, "all_dims"):
        want, got = R.rollup(fact, name), spark.read.parquet(f"{now}/{name}")
        if name in R.ROLLUPS:
            got = got.groupBy(*R.ROLLUPS[name]).agg(*(F.sum(c).alias(c) for c in (*R.SUMS.values(), "fact_row_count")))
        cols = want.columns
        text = [F.col(c).cast("string") if not c.startswith(("total", "sum_")) else F.col(c).cast("decimal(30,4)") for c in cols]
        assert sorted(map(str, got.select(*text).collect())) == sorted(map(str, want.select(*text).collect())), name


def test_versions(spark, rolled):
    fact, at = rolled
    old = stored.current(spark, at)
    held = spark.read.parquet(f"{old}/branch_brand")
    n = held.count()
    with pytest.raises(Exception, match="nothing_such"):
        R.refresh(fact.withColumn("brand", F.expr("raise_error('nothing_such')")), at)
    assert stored.current(spark, at) == old and held.count() == n  # a refresh that fails is never seen
    new = R.refresh(fact.limit(10), at, ("branch_brand",), wide=False)
    assert stored.current(spark, at) == new and held.count() == n and R.stored_names(spark, new) == {"branch_brand"}
    stored.publish(spark, at, old.rsplit("/", 1)[1])
    assert stored.current(spark, at) == old


def test_vacuum(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", "2024-01-01", 1.0, 1.0, 1.0)] * 3, "branch string, brand string, bill_date string, net_amount double, amount_before_tax double, sl_qty double")
    made = [R.refresh(df, str(tmp_path), ("branch_brand",), wide=False) for _ in range(4)]
    assert stored.vacuum(spark, str(tmp_path), 2) == 2
    assert [os.path.exists(m) for m in made] == [False, False, True, True] and stored.current(spark, str(tmp_path)) == made[-1]


@pytest.mark.parametrize("axes", [["state", "month"], ["state", "mmm"], ["fy"], ["month", "fy", "brand"], ["agent_name", "month"], ["branch", "brand"], ["party_grouped"]])
def test_time_from_months(spark, rolled, axes):
    fact, at = rolled
    values = [("net_amount", "sum"), ("sl_qty", "avg"), ("id", "count")]
    name = R.choose(axes, values, [])
    assert name is not None and set(axes) <= R.answers(name)
    if axes == ["state", "month"]:
        assert name == "state_month"
    got = R.pivot_from_rollup(fact, at, axes, values).collect()
    want = P.pivot_groupby(fact, P.config(axes, [], values)).drop("row_count").collect()

    def rows(rs):
        return sorted(str([str(v)[:12] if isinstance(v, float) else str(v) for v in r]) for r in rs)

    assert rows(got) == rows(want) and len(got) > 1


def test_choice():
    one = [("net_amount", "sum")]
    assert R.choose(["branch", "brand"], one, []) == "branch_brand"
    assert R.choose(["brand"], one, []) == "branch_brand"
    assert R.choose(["state", "brand"], one, []) == "state_party_brand"
    assert R.choose(["state", "month", "fy"], one, []) == "state_month"
    assert R.choose(["state"], one, ["month"]) is None and R.choose(["city"], one, []) is None and R.choose(["brand"], [("rate_unit", "sum")], []) is None
    assert R.choose(["brand"], one, [], {"party_grouped_brand"}) == "party_grouped_brand"


def test_freshness(spark, tmp_path):
    fact = spark.createDataFrame([(1, "2023-24", "a"), (2, "2023-24", "a"), (3, "2024-25", "b"), (4, "2024-25", "c"), (5, " ", "d"), (6, None, "e")], "id long, fy string, branch string").withColumns({c: F.lit(1.0) for c in R.ALL_SUMS})
    assert [tuple(r) for r in R.check_fresh(fact, str(tmp_path / "none")).collect()] == [("2024-25", 2, 0, True, True)]
    R.refresh(fact.where("fy <> '2024-25'"), at := str(tmp_path / "r"), ("all_dims",))
    assert [tuple(r) for r in R.check_fresh(fact, at).collect()] == [("2024-25", 2, 0, True, False)]
    R.refresh(fact, at, ("all_dims",))
    assert [tuple(r) for r in R.check_fresh(fact, at).collect()] == [("2024-25", 2, 2, False, False)]
    assert R.freshness(fact.where("id > 4"), fact).collect() == []


def test_distinct_source(spark, rolled):
    fact, at = rolled
    assert {f: R.distinct_source(fact, at, f)[1] for f in ("branch", "party_grouped", "fy", "month", "mmm", "city", "to_party_name")} == {"branch": "agent_final_branch", "party_grouped": "party_grouped_brand", "fy": "fact", "month": "fact", "mmm": "fact", "city": "fact", "to_party_name": "agent_party_month"}
    df, _ = R.distinct_source(fact, at, "branch")
    assert P.distinct_values(df, "branch").collect() == P.distinct_values(fact.where(R.not_total_pivot()), "branch").collect()


def test_stream_parts_stay_few(spark, tmp_path):
    """Fifty batches, a stop between a merge and the deletes, a batch that runs again: sums stay right, parts few."""
    rng = random.Random(5)
    schema = "state string, branch string, bill_date date, net_amount decimal(15,4), amount_before_tax decimal(15,4), sl_qty decimal(15,4)"
    rows = [(rng.choice("ABC"), "b", None, rng.randint(1, 99), 1, 1) for _ in range(50)]
    kinds = [F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]
    one = spark.createDataFrame(rows, "state string, branch string, bill_date date, net_amount long, amount_before_tax long, sl_qty long").select(*kinds)
    one.coalesce(1).write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "in"))
    at = str(tmp_path / "out")
    ingest.rollup_stream(spark, schema, str(tmp_path / "in"), at, str(tmp_path / "log"), "state_month", every=4, maxFilesPerTrigger=1).awaitTermination()
    n = len(glob.glob(str(tmp_path / "in" / "*.parquet")))
    parts = ingest._parts(spark, at)
    assert n == 50 and len(parts) <= 2 * 4 + 1 and max(p[1] for p in parts) == n - 1

    def total():
        got = ingest.merged(spark, at).groupBy("state").agg(F.sum("total_net").alias("t"), F.sum("fact_row_count").alias("n")).collect()
        return {r.state: (int(r.t), r.n) for r in got}

    want = {s: (sum(r[3] for r in rows if r[0] == s), sum(r[0] == s for r in rows)) for s in {r[0] for r in rows}}
    assert total() == want
    # merged, but the parts it holds are still there; then a batch it holds is written again
    last = max(p[1] for p in parts)
    ingest.merged(spark, at).coalesce(1).write.parquet(f"{at}/part-0-{last}" if (0, last) not in parts else f"{at}/part-0-{last + 1}")
    spark.read.parquet(next(iter(parts.values()))).write.mode("overwrite").parquet(f"{at}/part-3-3")
    assert total() == want
    ingest.compact(spark, at, 4)
    assert total() == want and len(ingest._parts(spark, at)) == 1
