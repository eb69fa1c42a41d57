"""Every registered query of the sales model against DuckDB."""

import datetime
import decimal
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from saleslattice.plans import catalog as Q
from saleslattice.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, decimal.Decimal):
        return f"{v:.6f}"
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat()[:10] if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


#: Queries whose keys may meet in larger tables only; they are compared there too.
LARGER, MORE = "/root/testdata/sf0.01", ("upsert_so_master", "upsert_party_grouping", "cascade_customer_type", "cascade_agent", "edit_master_row", "pivot_from_rollup", "scan_grid", "delete_range")


def tables(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return tables(SF)


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of each query, several at a time: most of their time is planning."""

    def run(name):
        df = Q.QUERIES[name](spark, SF)
        return sorted(df.columns), df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in Q.QUERIES}
        pool.shutdown(cancel_futures=True)


def same(duck, name, columns, rows):
    got = sorted(tuple(norm(r[c]) for c in columns) for r in rows)
    if name not in Q.SQL:
        assert got
        return
    rel = duck.sql(Q.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(duck, results, name):
    same(duck, name, *results[name].result())


@pytest.mark.parametrize("name", MORE)
def test_larger(spark, name):
    df = Q.QUERIES[name](spark, LARGER)
    same(tables(LARGER), name, sorted(df.columns), df.collect())
