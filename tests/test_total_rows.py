"""Total rows of grids: the columns of the reference."""

import pytest
from pyspark.sql import functions as F

from saleslattice.operators import filters as W
from saleslattice.operators import lookups as L
from saleslattice.plans.table_queries import _all
from saleslattice.sources.fixtures import load

MARKS = {"branch": "Total", "item_no": " GRAND TOTAL ", "to_party_name": "grandtotal", "party_name_for_count": "Grand Total 2", "party_grouped": "total", "agent_names_correction": "Grand Total", "brand": "total"}


@pytest.fixture(scope="module")
def rows(spark):
    cols = ["state", "bill_no", *MARKS]
    made = [("Total", "b0", *["x"] * 7), ("s", "b1", *["subtotal"] * 7), ("s", "b2", *[None] * 7)]
    made += [("s", f"m{i}", *[MARKS[c] if c == m else "x" for c in MARKS]) for i, m in enumerate(MARKS)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(made)], "id long, " + ", ".join(f"{c} string" for c in cols))


def test_grid(rows, spark):
    groups = spark.createDataFrame([], "to_party_name string, party_grouped string")
    assert {r.bill_no for r in W.grid_page(rows, groups).collect()} == {"b0", "b1", "b2"}
    assert {r.bill_no for r in L.enrich_display(rows, {}, complete=True).collect()} == {"b0", "b1", "b2"}


def test_enriched_names(spark, sf):
    masters = _all(spark, sf)
    df = load(spark, sf).where("branch <> 'Grand Total'").limit(4)
    marked = df.withColumn("agent_name", F.lit("Grand Total"))
    assert L.enrich_display(df, masters).count() == 4 and L.enrich_display(marked, masters).count() == 0
