"""Ledgers and histories: job states, uploads, edits with before and after images, previews and health of masters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def edit_history(events: DataFrame, before: DataFrame, after: DataFrame, table: str | None = None, limit: int = 100) -> DataFrame:
    """Newest events (id, table_name, ts) with their images (event_id, payload); an event without an image keeps null."""
    some = events.where(F.col("table_name") == table) if table else events
    newest = some.orderBy(F.desc("ts"), F.desc("id")).limit(min(max(limit, 1), 300))
    b = before.select(F.col("event_id").alias("_b"), F.col("payload").alias("before"))
    a = after.select(F.col("event_id").alias("_a"), F.col("payload").alias("after"))
    return newest.join(b, F.col("id") == F.col("_b"), "left").join(a, F.col("id") == F.col("_a"), "left").drop("_b", "_a")


def row_snapshot(history: DataFrame, masters: dict[str, DataFrame]) -> DataFrame:
    """history (table_name, row_id, ...) with snapshot: the master's present row as JSON, without id and created_at."""
    rows = [m.select(F.lit(t).alias("table_name"), F.col("id").cast("string").alias("row_id"), F.to_json(F.struct(*(c for c in m.columns if c not in ("id", "created_at")))).alias("snapshot")) for t, m in masters.items()]
    key = history.withColumn("row_id", F.col("row_id").cast("string"))
    return key.join(reduce(DataFrame.unionByName, rows), ["table_name", "row_id"], "left")


def top(ledger: DataFrame, by: str, limit: int = 20, most: int = 300) -> DataFrame:
    """Latest lines; lines without a time come last."""
    return ledger.orderBy(F.desc_nulls_last(by), F.desc("id")).limit(min(max(limit, 1), most))


def purge(ledger: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """The ledger without finished jobs that ended more than days ago; jobs without an end stay."""
    old = F.col("status").isin("completed", "failed", "cancelled") & (F.col("ended") < F.date_sub(now, days))
    return ledger.where(~F.coalesce(old, F.lit(False)))


def has_text(df: DataFrame, term: str) -> Column:
    """Whether any text column contains the term, whatever its case."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(term.lower()), F.lit(False)) for c in map(F.col, texts)), F.lit(False))


def so_preview(orders: DataFrame, brand: str, fy: str, limit: int = 20) -> DataFrame:
    """First orders, by party, of a brand and year, each with the number of all of them."""
    rows = orders.where((F.col("brand") == brand) & (F.col("fy") == fy))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("party_name", "id").limit(limit).join(F.broadcast(total), how="cross")


def master_preview(master: DataFrame, term: str = "", by: str = "id", limit: int = 200) -> DataFrame:
    """Newest rows of a master, of those that hold the term in any text column."""
    found = master.where(has_text(master, term)) if term else master
    return found.orderBy(F.desc_nulls_last(by)).limit(min(max(limit, 1), 500))


def health(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """table_name, column_name, n_rows, n_blank of each named column, one aggregate a table."""
    out = []
    for t, (df, cols) in tables.items():
        got = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(X.null_if_blank(F.col(c).cast("string")).isNull()).alias(c) for c in cols))
        out.append(got.select(F.explode(F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(c).alias("n_blank")) for c in cols))).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, out)
