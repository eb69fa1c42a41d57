"""Pivot bodies: lines with subtotals between rows, windows of lines, caps of groups and headers, wide grids and CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.scratch import checkpointed
from .pivot import header_key, names, pivot


def _order(labels: Column) -> Column:
    """Order key of label lists; a subtotal's key is its prefix's, after all rows that start with it."""
    return F.transform(labels, lambda x: header_key(x))


def body_lines(df: DataFrame, cfg: dict) -> DataFrame:
    """type (row or subtotal), depth, labels and key of a body's lines: each prefix's subtotal follows its last row. Sort
    by key."""
    n = len(cfg["rows"])
    depths = sorted({cfg["rows"].index(s) + 1 for s in cfg["subtotals"]})
    got = pivot(df, {**cfg, "columns": []}).where(F.col("depth").isin([*depths, n]))
    rows = got.where(F.col("depth") == n)
    if n in depths:  # a subtotal of the whole row repeats it
        rows = rows.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
    else:
        rows = rows.withColumn("_k", F.lit(0))
    subs = got.where(F.col("depth") < n).withColumn("_k", F.lit(1))
    lines = rows.unionByName(subs)
    # Labels of one depth are followed by a mark that sorts after every label: 9 is past all header classes.
    last = F.struct(F.lit(9).alias("k"), F.lit(0).alias("n"), F.collate(F.lit(""), X.BASE_ORDER).alias("t"), F.lit("").alias("l"))
    key = F.when(F.col("_k") == 1, F.concat(_order(F.col("row_labels")), F.array(last))).otherwise(_order(F.col("row_labels")))
    return lines.select(F.when(F.col("_k") == 1, "subtotal").otherwise("row").alias("type"), "depth", F.col("row_labels").alias("labels"), key.alias("key"), *names(cfg))


def body_window(df: DataFrame, cfg: dict, offset: int = 0, limit: int = 1000) -> DataFrame:
    """Lines offset + 1 to offset + limit (at most 100,000) of the body, with the number of all lines."""
    lines = body_lines(df, cfg)
    first = lines.orderBy("key").offset(max(0, offset)).limit(min(max(limit, 1), 100_000))
    total = lines.agg(F.count(F.lit(1)).alias("total_lines"))
    return first.join(F.broadcast(total), how="cross")


def cap_groups(df: DataFrame, dims: list[str], cap: int = 80_000) -> DataFrame:
    """The first groups by their dimensions, each with the number of groups that the cap leaves out."""
    cap = min(max(cap, 1000), 500_000)
    total = df.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("dropped"))
    return df.orderBy(*(F.asc_nulls_last(d) for d in dims)).limit(cap).join(F.broadcast(total), how="cross")


def cap_cells(cells: DataFrame, metrics: int, cap: int = 250_000) -> DataFrame:
    """Cells of the first row and column headers whose dense grid stays within the cap: rows first, then columns."""
    rows = cells.select("row_labels").distinct().orderBy(_order(F.col("row_labels"))).limit(cap)
    key = _order(F.col("col_labels"))
    cols = cells.select("col_labels").distinct().orderBy(key).limit(cap)  # so that the window below has cap rows at most
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    ranked = cols.withColumn("line", F.row_number().over(Window.orderBy(key)))
    fit = ranked.join(F.broadcast(n), how="cross").where(F.col("line") * F.col("n") * metrics <= cap).select("col_labels")
    return cells.join(rows, "row_labels", "left_semi").join(fit, "col_labels", "left_semi")


def dense_grid(df: DataFrame, cfg: dict, cap: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """(headers, rows) of a pivot's grid. headers: place and col_labels of the columns in order, the first whose cells fit the cap;
    rows: row_labels and, for each metric, an array with a cell for each header, in their order: 0 for a sum, an average or a
    count of no rows, null for their least and greatest.

    A row's cells are gathered by the places of their headers and spread over an array of the headers' number: rows and headers are
    not crossed. The cap bounds the headers."""
    from .pivot import sort_headers

    every = F.array(F.lit("(all)"))
    cell = {(True, True): "cell", (True, False): "row_total", (False, True): "cell", (False, False): "grand_total"}[bool(cfg["rows"]), bool(cfg["columns"])]
    got = pivot(df, {**cfg, "subtotals": []}).where(F.col("kind") == cell)
    got = checkpointed(got.withColumns({c: F.when(F.size(c) == 0, every).otherwise(F.col(c)) for c in ("row_labels", "col_labels")}))
    metrics = list(names(cfg))
    labels = got.select("row_labels").distinct()
    most = max(1, cap // (max(1, labels.count()) * len(metrics)))
    heads = got.select(F.col("col_labels").alias("labels")).distinct()
    first = heads.orderBy(*(header_key(F.get("labels", F.lit(i)), f) for i, f in enumerate(cfg["columns"])), "labels").limit(most)
    placed = checkpointed(sort_headers(first, cfg["columns"]).withColumnRenamed("labels", "col_labels"))
    width = placed.count()
    cells = got.join(placed, "col_labels")
    gathered = cells.groupBy("row_labels").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct(*metrics)))).alias("at"))
    empty = {n: F.lit(None) if a in ("min", "max") else F.lit(0) for (f, a), n in zip(cfg["values"], metrics, strict=True)}

    def spread(n: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.try_element_at("at", i)[n], empty[n].cast(got.schema[n].dataType)))

    rows = labels.join(gathered, "row_labels", "left").select("row_labels", *((spread(n) if width else F.array().cast(f"array<{got.schema[n].dataType.simpleString()}>")).alias(n) for n in metrics))
    return placed.select("place", "col_labels"), rows


def export_grid(df: DataFrame, cfg: dict, headers: list[str]) -> DataFrame:
    """Rows by headers of the first value, with a total column and a last line of column totals (kind: body or total)."""
    value = next(iter(names(cfg)))
    got = pivot(df, {**cfg, "subtotals": []}).select("kind", "row_labels", F.coalesce(F.get("col_labels", F.lit(0)), F.lit("Total")).alias("h"), F.col(value).alias("v"))
    body = F.when(F.col("kind").isin("cell", "row_total"), "body").otherwise("total")
    return got.groupBy(body.alias("kind"), X.join_key(*(F.get("row_labels", F.lit(i)) for i in range(len(cfg["rows"])))).alias("row_key")).pivot("h", [*headers, "Total"]).agg(F.first("v")).withColumn("row_key", F.when(F.col("kind") == "total", "Grand Total").otherwise(F.col("row_key")))


def export_pivot_csv(df: DataFrame, cfg: dict, headers: list[tuple[str, ...]]) -> DataFrame:
    """part, key, line of a pivot's CSV text: sort by part and key. Part 0: a header line for each column level (the byte
    order mark before the first) and one of metrics; part 1: rows; part 2: the footer. headers: the column labels to show,
    a tuple each. Whole numbers in Indian grouping, texts quoted where need be."""
    metrics, rows = list(names(cfg)), cfg["rows"] or ["ROWS"]
    headers, depth = headers or [("(all)",)], max([1, *map(len, headers)])
    columns = [(tuple(h), n) for h in headers for n in metrics] + [(None, n) for n in metrics]

    def cell(c: Column) -> Column:
        return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))

    def line(cells: list[Column]) -> Column:
        return F.concat_ws(",", *map(cell, cells))

    top = []
    for level in range(depth):
        lead = [r.upper() for r in rows] if level == depth - 1 else ["ROWS", *[""] * (len(rows) - 1)]
        shown = [(h[level] if level < len(h) else "") if h is not None else "GRAND TOTAL" if level == depth - 1 else "" for h, _ in columns]
        top.append([*lead, *(x.upper() for x in shown)])
    label = {f"{a}_{f}": f"{a.upper()} {f}" for f, a in cfg["values"]}
    top.append([*[""] * len(rows), *(label[n] for _, n in columns)])
    heads = df.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(f"{i}").alias("key"), F.concat(F.lit("\ufeff" if i == 0 else ""), line([F.lit(x) for x in t])).alias("line")) for i, t in enumerate(top)))).alias("x")).select(F.lit(0).alias("part"), "x.*")
    got = pivot(df, {**cfg, "subtotals": []})
    if not cfg["columns"]:  # then a row's only column is all, and so is its total
        both = got.withColumn("h", F.explode(F.array(F.lit("(all)"), F.lit(None).cast("string"))))
    else:
        both = got.withColumn("h", F.when(F.size("col_labels") > 0, F.array_join("col_labels", "||")))
    part = F.when(F.col("kind").isin("column_total", "grand_total") & F.lit(bool(cfg["rows"])), 2).otherwise(1)
    picked = [F.max(F.when(F.col("h").isNull() if h is None else F.col("h") == "||".join(h), F.round(F.col(n), 0))).alias(f"v{i}") for i, (h, n) in enumerate(columns)]
    wide = both.groupBy(part.alias("part"), "row_labels").agg(*picked)
    lead = [F.when(F.col("part") == 2, "GRAND TOTAL" if i == 0 else "").otherwise(F.coalesce(F.get("row_labels", F.lit(i)), F.lit("(all)" if i == 0 else ""))) for i in range(len(rows))]
    values = [X.format_indian(F.col(f"v{i}")) for i in range(len(columns))]
    return heads.unionByName(wide.select("part", F.array_join("row_labels", "||").alias("key"), line([*lead, *values]).alias("line")))
