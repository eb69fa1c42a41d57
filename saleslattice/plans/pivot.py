"""Pivots: one grouping-sets aggregate for cells, row, column and grand totals and prefix subtotals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.filters import where

AGGREGATES = ("sum", "count", "avg", "min", "max")


def measure(agg: str, field: str) -> Column:
    """sum of nothing is 0; count counts rows; avg divides by all rows, nulls too."""
    if agg == "count":
        return F.count(F.lit(1))
    x = X.fact_numeric(field)
    total = F.coalesce(F.sum(x), F.lit(0).cast("decimal(25,4)"))
    if agg == "avg":
        return total.cast("double") / F.count(F.lit(1))
    return {"sum": total, "min": F.min(x), "max": F.max(x)}[agg]


def config(rows=(), columns=(), values=(), filters=(), subtotals=(), casefold=False) -> dict:
    """Arguments of a pivot, checked: at most 32 axes and 12 values, measures only for other aggregates than count."""
    rows, columns = list(dict.fromkeys(rows)), [c for c in dict.fromkeys(columns) if c not in rows]
    kept = [(f, a) for f, a in values if a in AGGREGATES]
    if not kept and (rows or columns):
        kept = [("id", "count")]
    if len(rows) + len(columns) > 32 or not 1 <= len(kept) <= 12:
        raise ValueError("axes or values")
    if any(a != "count" and f not in X.MEASURES for f, a in kept):
        raise ValueError("not a measure")
    return {"rows": rows, "columns": columns, "values": kept, "filters": list(filters), "subtotals": [s for s in subtotals if s in rows], "casefold": casefold}


def partials(values: list[tuple[str, str]]) -> dict[str, Column]:
    """What must be kept of a group, so that groups can be put together by merged()."""
    out = {"_rows": F.count(F.lit(1))}
    for f, a in values:
        if a in ("sum", "avg"):
            out[f"_sum_{f}"] = F.sum(X.fact_numeric(f))
        elif a != "count":
            out[f"_{a}_{f}"] = (F.min if a == "min" else F.max)(X.fact_numeric(f))
    return out


def merged(agg: str, field: str) -> Column:
    """measure() over groups of partials()."""
    rows = F.sum("_rows")
    if agg == "count":
        return rows
    if agg in ("min", "max"):
        return (F.min if agg == "min" else F.max)(f"_{agg}_{field}")
    total = F.coalesce(F.sum(f"_sum_{field}"), F.lit(0)).cast("decimal(25,4)")
    return total.cast("double") / rows if agg == "avg" else total


def names(cfg: dict) -> dict[str, Column]:
    return {f"{a}_{f}": measure(a, f) for f, a in cfg["values"]}


def pivot_groupby(df: DataFrame, cfg: dict) -> DataFrame:
    dims = cfg["rows"] + cfg["columns"]
    base = df.where(where(cfg["filters"], casefold=cfg["casefold"]))
    return base.groupBy(*(X.dim_axis(d).alias(f"d_{d}") for d in dims)).agg(*(m.alias(n) for n, m in names(cfg).items()), F.count(F.lit(1)).alias("row_count"))


def pivot(df: DataFrame, cfg: dict) -> DataFrame:
    """kind (cell, row_total, column_total, grand_total, subtotal, subtotal_total), depth, row_labels, col_labels and
    metrics. Blank axes are labelled before grouping, so that null only means "all". Rows are first aggregated by what tells
    all axes' labels; only these groups are labelled and expanded to the grouping sets."""
    rows, cols = [f"r_{c}" for c in cfg["rows"]], [f"c_{c}" for c in cfg["columns"]]
    base = df.where(where(cfg["filters"], casefold=cfg["casefold"]))
    axes = dict(zip(rows + cols, cfg["rows"] + cfg["columns"]))
    parts = {c: [x.alias(f"_{i}_{c}") for i, x in enumerate(X.axis_parts(f))] for c, f in axes.items()}
    fine = base.groupBy(*sum(parts.values(), [])).agg(*(x.alias(n) for n, x in partials(cfg["values"]).items()))
    fine = fine.withColumns({c: X.label_of_parts(f, [F.col(f"_{i}_{c}") for i in range(len(parts[c]))]) for c, f in axes.items()})
    sets = {tuple(rows + cols), tuple(rows), tuple(cols), ()}
    for s in cfg["subtotals"]:
        d = cfg["rows"].index(s) + 1
        if d < len(rows):
            sets |= {tuple(rows[:d] + cols), tuple(rows[:d])}
    got = fine.groupingSets([[F.col(c) for c in s] for s in sorted(sets)], *(F.col(c) for c in rows + cols)).agg(*(merged(a, f).alias(f"{a}_{f}") for f, a in cfg["values"]))
    depth = sum((F.col(c).isNotNull().cast("int") for c in rows), F.lit(0))
    whole, across = depth == len(rows), (F.col(cols[0]).isNotNull() if cols else F.lit(False))
    kind = F.when(whole & across, "cell").when(whole & (depth > 0), "row_total").when((depth == 0) & across, "column_total").when(depth == 0, "grand_total").when(across, "subtotal").otherwise("subtotal_total")
    return got.select(kind.alias("kind"), depth.cast("int").alias("depth"), F.filter(F.array(*map(F.col, rows)).cast("array<string>"), lambda x: x.isNotNull()).alias("row_labels"), F.filter(F.array(*map(F.col, cols)).cast("array<string>"), lambda x: x.isNotNull()).alias("col_labels"), *names(cfg))


def header_key(label: Column, field: str | None = None) -> Column:
    """Order of labels: dates, fiscal years, months, texts in natural order without case and accents, blank last; ties by the
    label itself. field: the labels' field, whose kind of value alone is read; without it, all kinds are told by their form."""
    month, only, year = X.month_year(label), X.month_only(label), X.fy_start(label)
    day = F.when(label.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(label, 1, 10), "yyyy-MM-dd"))
    if field is None:
        only = F.when(F.upper(label).isin(*X.MONTHS), only)
        year = F.when(label.rlike(r"^\d{4}-\d{2}$"), year)
    none = F.lit(None).cast("int")
    date_n = F.datediff(day, F.lit("1970-01-01").cast("date")) if field is None or field in X.DATES else none
    fy_n = year if field in (None, "fy") else none
    month_n = F.coalesce(month["y"] * 12 + month["m"] if field in (None, "month", "mmm") else none, only if field in (None, "mmm") else none)
    kind = F.when((label == "(blank)") | (label == ""), 4).when(date_n.isNotNull(), 0).when(fy_n.isNotNull(), 1).when(month_n.isNotNull(), 2).otherwise(3)
    num = F.when(kind < 3, F.coalesce(F.when(kind == 0, date_n), F.when(kind == 1, fy_n), month_n)).otherwise(0)
    return F.struct(kind.alias("k"), num.alias("n"), F.when(kind == 3, X.natural_sort_key(label)).alias("t"), label.alias("l"))


def sort_headers(headers: DataFrame, fields: list[str], desc: bool = False) -> DataFrame:
    """headers (labels: array of a label a field) with place, from 1 on: in the order of their labels' kinds, field by field, or
    all reversed, blanks included. Headers are those of a pivot's columns, few enough to be shown (cap_cells)."""
    keys = [header_key(F.get("labels", F.lit(i)), f) for i, f in enumerate(fields)] + [F.array_join("labels", "||")]
    order = [k.desc() if desc else k.asc() for k in keys]
    return headers.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def drill_rows(df: DataFrame, cfg: dict, keys: dict[str, str]) -> DataFrame:
    """All rows behind one cell. keys: a label a field; an empty one and (all) ask for nothing, (blank) for blank values."""
    cond = where(cfg["filters"])
    for f, v in keys.items():
        if v in ("", "(all)"):
            continue
        c = F.col(f)
        text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
        cond = cond & ((c.isNull() if f in X.DATES else text == "") if v == "(blank)" else c.cast("date") == F.lit(v).cast("date") if f in X.DATES else text == v)
    return df.where(cond)


def cell_keys(cfg: dict, row_key: str, col_key: str) -> dict[str, str]:
    """A cell's labels by field, from its keys: labels joined by ||, missing ones empty."""
    out = {}
    for fields, key in ((cfg["rows"], row_key), (cfg["columns"], col_key)):
        parts = key.split("||") if key else []
        out |= {f: parts[i] if i < len(parts) else "" for i, f in enumerate(fields)}
    return out


def drilldown(df: DataFrame, cfg: dict, keys: dict[str, str], offset: int = 0, limit: int = 200) -> DataFrame:
    """Rows behind one cell, in id order: a page of them."""
    return drill_rows(df, cfg, keys).orderBy("id").offset(max(0, offset)).limit(min(max(limit, 1), 1000))


def drilldown_total(df: DataFrame, cfg: dict, keys: dict[str, str]) -> DataFrame:
    """One row: total, the number of rows behind one cell."""
    return drill_rows(df, cfg, keys).agg(F.count(F.lit(1)).alias("total"))


def distinct_values(df: DataFrame, field: str, search: str = "", limit: int = 10_000) -> DataFrame:
    v = X.dim_axis(field).cast("string")
    out = df.select(v.alias("value")).where(F.col("value").isNotNull()).distinct()
    if search:
        out = out.where(F.lower("value").contains(search.lower()))
    return out.orderBy(F.lower("value"), "value").limit(min(max(limit, 1), 20_000))


def distinct_lists(df: DataFrame, fields: list[str], at: str, limit: int = 10_000) -> dict[str, DataFrame]:
    """distinct_values() of several fields, by field. df is read once: its distinct pairs of field and value are written to the folder
    at, and each field's values come from there."""
    pairs = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), X.dim_axis(f).cast("string").alias("value")) for i, f in enumerate(fields)))
    df.select(F.explode(pairs).alias("x")).select("x.*").where("value IS NOT NULL").distinct().write.parquet(at)
    stored = df.sparkSession.read.schema("field tinyint, value string").parquet(at)
    return {f: stored.where(F.col("field") == i).select("value").orderBy(F.lower("value"), "value").limit(min(max(limit, 1), 20_000)) for i, f in enumerate(fields)}


#: Values that one ranking keeps: up to here Spark limits each partition's groups before it shuffles them.
STEP = 1000


def first_values(pairs: DataFrame, limit: int) -> DataFrame:
    """The first limit values (in order without case) of each field of pairs (field, value; distinct). They are taken STEP at a time,
    so that no task sorts more of a field than its partitions' first ones; later steps start after the last value so far."""
    at, order = F.struct(F.lower("value").alias("a"), F.col("value").alias("b")), (F.lower("value"), F.col("value"))
    out, rest = [], pairs
    for done in range(0, limit, STEP):
        ranked = rest.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy(*order)))
        out.append(ranked.where(F.col("n") <= min(STEP, limit - done)).select("field", "value"))
        if done + STEP < limit:  # a row a field that goes on
            last = out[-1].groupBy(F.col("field").alias("_f")).agg(F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == STEP)
            rest = rest.join(F.broadcast(last), (F.col("field") == F.col("_f")) & (at > F.col("_last"))).select("field", "value")
    return reduce(DataFrame.unionByName, out)


def distinct_values_batch(df: DataFrame, fields: list[str], limit: int = 500) -> DataFrame:
    """field, value, error: up to 24 fields' values in one pass; the limit (50 to 2000) keeps each field's first values. A
    field that df lacks has one row with an error. No field, or more than 24, is refused."""
    fields = list(dict.fromkeys(f.strip() for f in fields if f and f.strip()))
    if not 1 <= len(fields) <= 24:
        raise ValueError("1 to 24 fields")
    known = [f for f in fields if f in df.columns]
    # fields are numbers until their first values are found: the keys of so many rows are to be short
    pairs = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), X.dim_axis(f).cast("string").alias("value")) for i, f in enumerate(known))).cast("array<struct<field:tinyint,value:string>>")
    every = df.select(F.explode(pairs).alias("x")).select("x.*").where("value IS NOT NULL").distinct()
    name = F.get(F.array(*map(F.lit, known)).cast("array<string>"), F.col("field").cast("int"))
    out = first_values(every, min(max(limit, 50), 2000)).select(name.alias("field"), "value", F.lit(None).cast("string").alias("error"))
    unknown = [(f, None, "Invalid filter field") for f in fields if f not in df.columns]
    return out.unionByName(df.sparkSession.createDataFrame(unknown, "field string, value string, error string")) if unknown else out


def distinct_states(df: DataFrame) -> DataFrame:
    return df.where(F.trim("state") != "").select("state").distinct().orderBy("state")


def _with_cells(df: DataFrame, fields: list[str]) -> DataFrame:
    cells = F.lit(1).cast("bigint")
    for f in fields:
        cells = cells * F.greatest(F.col(f), F.lit(1))
    return df.withColumn("cells", cells)


def axis_cardinality(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the number of distinct values of each field, and their product as cells."""
    return _with_cells(df.agg(*(F.countDistinct(f).alias(f) for f in fields)), fields)


def sketch_axes(df: DataFrame, fields: list[str], by: list[str] | None = None, bits: int = 12) -> DataFrame:
    """A HyperLogLog sketch of each field's values (columns of its name), for each value of by, or one row: to be stored with the
    parts of a table and put together by estimated_cardinality(). 2**bits registers: a standard error of 1.04 / 2**(bits / 2)."""
    made = [F.hll_sketch_agg(F.col(f).cast("string"), F.lit(bits)).alias(f) for f in fields]
    return df.groupBy(*by).agg(*made) if by else df.agg(*made)


def estimated_cardinality(sketches: DataFrame, fields: list[str]) -> DataFrame:
    """axis_cardinality() as estimated from stored sketches; the table itself is not read."""
    got = sketches.agg(*(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f)), F.lit(0)).cast("bigint").alias(f) for f in fields))
    return _with_cells(got, fields)


def report_meta(df: DataFrame) -> DataFrame:
    """fy and its months, in the order of the calendar (names of no month last), years rising."""
    month = X.month_axis()
    number = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, X.MONTHS)), F.upper(F.substring(F.trim(month), 1, 3))), F.lit(0)), F.lit(99))
    each = df.select(X.fy_axis().alias("fy"), F.struct(number.alias("o"), month.alias("m")).alias("x")).where("fy IS NOT NULL AND x.m IS NOT NULL").distinct()
    return each.groupBy("fy").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]).alias("months")).orderBy("fy")


def pivot_quick(df: DataFrame, field: str, value: str = "net_amount") -> DataFrame:
    """Sum of a value by one field."""
    return pivot_groupby(df, config([field], [], [(value, "sum")]))


def pivot_casefold(df: DataFrame, agents: DataFrame, cfg: dict) -> DataFrame:
    """pivot() with filters that ignore case, over rows whose agent names and fiscal time are filled in as they are shown."""
    from ..operators.lookups import display_agent

    filled = display_agent(df, agents).withColumn("_t", X.temporal_triple())
    filled = filled.withColumns({c: F.coalesce(X.null_if_blank(F.col(c)), F.col(f"_t.{c}")) for c in ("fy", "month", "mmm")}).drop("_t")
    return pivot(filled, {**cfg, "casefold": True})
