"""Header rows of raw grids: resolution by an alias table, validation, column positions, typed rows and master imports.

aliases: norm_header, canonical, priority. A header may stand for several canonical names. Grids are of sheet, rn, cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.scratch import checkpointed


def resolve_header(heads: DataFrame, aliases: DataFrame) -> DataFrame:
    """heads (sheet, pos, header) with canonical, one row for each name a header stands for; unknown headers go."""
    keyed = heads.withColumn("_k", X.normalize_header(F.coalesce("header", F.lit("")))).where("_k <> ''")
    names = aliases.select(F.col("norm_header").alias("_k"), "canonical", "priority")
    return keyed.join(names, "_k").drop("_k")


def header_cells(grid: DataFrame, rows: int = 30) -> DataFrame:
    """sheet, rn, pos, header of the cells of each sheet's first rows, without column A."""
    top = grid.where(F.col("rn") <= rows).select("sheet", "rn", F.posexplode("cells").alias("pos", "header"))
    return top.where("pos > 0").withColumn("pos", F.col("pos") - 1)


#: Headers that an import of sales needs, the two of which it needs one, and those that it never reads from a file.
REQUIRED = (
    "BRANCH", "STATE", "CITY", "BRAND", "AGENT NAME", "TO PARTY NAME", "BILL NO.", "BILL Date", "SHADE NAME", "RATE/UNIT", "SIZE", "UNITS/PACK", "SL QTY", "GROSS AMOUNT",
    "AMOUNT BEFORE TAX", "NET AMOUNT", "SALE ORDER NO.", "SALE ORDER Date", "Item Category", "Item Sub cat",
)
ITEM = ("ITEM NAME", "ITEM NO")
EXCLUDED = ("FY", "MONTH", "MMM", "REGION", "DISTRICT", "TYPE OF Business", "Agent Names Correction", "SCHEME", "GOODS TYPE", "AGENT NAME.", "Item with Shade", "PIN CODE")


def missing_headers(heads: DataFrame, aliases: DataFrame, required: list[str] | tuple[str, ...] = REQUIRED, either: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """sheet, rn, missing: the required names that a header row lacks, in their order; then, for each of either, "A or B" where it
    has none of them."""
    known = resolve_header(heads, aliases).groupBy("sheet", "rn").agg(F.collect_set("canonical").alias("_have"))
    rows = heads.select("sheet", "rn").distinct().join(known, ["sheet", "rn"], "left")
    have = F.coalesce("_have", F.array().cast("array<string>"))
    ors = F.filter(F.array(*(F.when(~F.arrays_overlap(have, F.array(*map(F.lit, names))), F.lit(" or ".join(names))) for names in either)).cast("array<string>"), lambda x: x.isNotNull())
    return rows.select("sheet", "rn", F.concat(F.array_except(F.array(*map(F.lit, required)), have), ors).alias("missing"))


def validate_headers(heads: DataFrame, aliases: DataFrame, required: list[str] | tuple[str, ...] = REQUIRED, either: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """missing_headers() with valid and the first missing name."""
    got = missing_headers(heads, aliases, required, either)
    return got.select("sheet", "rn", (F.size("missing") == 0).alias("valid"), F.get("missing", F.lit(0)).alias("first_missing"))


def numbered(df: DataFrame, order: list[str], name: str = "number", start: int = 1) -> DataFrame:
    """df with the place of each row in the order (which has no ties), from start on, without gaps. Rows are dealt by ranges of
    the order; each partition numbers its own, from where the partitions before it end: no task sees all rows."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), local.alias("_at")))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    ends = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(ends), F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_before") + F.col("_at") + start).alias(name))


#: Rows of a sheet in which its header must be, and what is said where it isn't.
ATTEMPTS = 30
NO_HEADER = "Invalid headers: required header row not found after skips."


def first_headers(grid: DataFrame, aliases: DataFrame, required: list[str] | tuple[str, ...] = REQUIRED, either: tuple[tuple[str, ...], ...] = (ITEM,)) -> DataFrame:
    """sheet, head (row) and at (canonical to position) of the first row of each sheet, of its first ATTEMPTS ones, that has all
    required names."""
    heads = header_cells(grid, ATTEMPTS)
    good = validate_headers(heads, aliases, required, either).where("valid").groupBy("sheet").agg(F.min("rn").alias("rn"))
    return header_index(heads.join(good, ["sheet", "rn"], "left_semi"), aliases).groupBy("sheet", F.col("rn").alias("head")).agg(F.map_from_entries(F.collect_list(F.struct("canonical", "pos"))).alias("at"))


def read_rows(grid: DataFrame, heads: DataFrame, done: int = 0, cap: int | None = 2_500_000) -> DataFrame:
    """sheet, rn, number and at (canonical to text) of a grid's data rows: those after each sheet's header, numbered over all sheets
    from 2 on; without those up to number done, without each sheet's last row (its totals), at most cap of them (None: all). What is known of a sheet is one row, which is
    broadcast: rows are shuffled once, to be numbered, and without their header."""
    body = grid.join(F.broadcast(heads.select("sheet", "head")), "sheet").where(F.col("rn") > F.col("head")).drop("head")
    kept = resume_skip(drop_footer(numbered(body, ["sheet", "rn"], "number", 2)), done)
    some = kept if cap is None else row_cap(kept, cap)
    return some.join(F.broadcast(heads.select("sheet", "at")), "sheet").select("sheet", "rn", "number", F.transform_values(F.map_filter("at", lambda c, _: ~c.isin(*EXCLUDED)), lambda _, p: F.get("cells", p + 1)).alias("at"))


def sheet_errors(grid: DataFrame, heads: DataFrame) -> DataFrame:
    """sheet and error of the sheets that have no header among their first ATTEMPTS rows and go on after them; shorter ones without
    a header hold nothing to import."""
    long = grid.groupBy("sheet").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ATTEMPTS)
    return long.join(heads.select("sheet"), "sheet", "left_anti").select("sheet", F.lit(NO_HEADER).alias("error"))


def import_rows(grid: DataFrame, aliases: DataFrame, done: int = 0, cap: int | None = 2_500_000, required: list[str] | tuple[str, ...] = REQUIRED, either: tuple[tuple[str, ...], ...] = (ITEM,), check: bool = True) -> DataFrame:
    """read_rows() of the grid's sheets. check: fail, before anything is read, if a sheet has no header (see sheet_errors)."""
    heads = checkpointed(first_headers(grid, aliases, required, either))
    if check and (bad := sheet_errors(grid, heads).orderBy("sheet").limit(20).collect()):
        raise ValueError(f"{NO_HEADER} ({', '.join(str(r.sheet) for r in bad)})")
    return read_rows(grid, heads, done, cap)


def quantity_score(header: Column) -> Column:
    """How well a header fits SL QTY."""
    u = X.normalize_header_dots(header)
    qty = u.contains("QTY")
    return F.when(u.contains("SL") & (qty | u.contains("QUANT")), 100).when(u.contains("SEL") & qty, 80).when(u.isin("QTY", "QTY.") | u.startswith("QTY "), 25).otherwise(50)


def header_index(heads: DataFrame, aliases: DataFrame) -> DataFrame:
    """sheet, rn, canonical, pos: the last column of each name; for SL QTY the best score, then the leftmost."""
    got = resolve_header(heads, aliases)
    best = F.when(F.col("canonical") == "SL QTY", F.struct(quantity_score(F.col("header")).alias("s"), (-F.col("pos")).alias("p"))).otherwise(F.struct(F.lit(0).alias("s"), F.col("pos").alias("p")))
    return got.groupBy("sheet", "rn", "canonical").agg(F.max_by("pos", best).alias("pos"))


def data_rows(grid: DataFrame, index: DataFrame) -> DataFrame:
    """sheet, rn, and at (canonical to text) of the rows between each sheet's header and its last row."""
    heads = index.groupBy("sheet", "rn").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "pos"))).alias("at")).groupBy("sheet").agg(F.min_by(F.struct(F.col("rn").alias("head"), "at"), "rn").alias("h"))
    body = drop_footer(grid).join(F.broadcast(heads), "sheet").where(F.col("rn") > F.col("h.head"))
    return body.select("sheet", "rn", F.transform_values("h.at", lambda _, p: F.get("cells", p + 1)).alias("at"))


def drop_footer(grid: DataFrame) -> DataFrame:
    """The grid without the last row of each sheet. The last rows are found by an aggregate and broadcast, a number a sheet, so
    that a sheet of any size is no single task."""
    last = grid.groupBy("sheet").agg(F.max("rn").alias("_last"))
    return grid.join(F.broadcast(last), "sheet").where(F.col("rn") < F.col("_last")).drop("_last")


#: How a canonical column's cells are read; others are trimmed text.
NUMBERS = ("RATE/UNIT", "SL QTY", "UNITS/PACK", "GROSS AMOUNT", "AMOUNT BEFORE TAX", "NET AMOUNT")
DATES = ("BILL Date", "SALE ORDER Date")


def type_row(name: str) -> Column:
    """A canonical column of data_rows() by its kind; ITEM NO stands before ITEM NAME."""
    c = F.try_element_at("at", F.lit(name))
    if name in NUMBERS:
        return X.money_cell(c)
    if name in DATES:
        return X.parse_date_cell(c)
    if name in ITEM:  # the sheet's ITEM NO column, if it has one
        return X.null_if_blank(F.when(F.map_contains_key("at", F.lit("ITEM NO")), F.try_element_at("at", F.lit("ITEM NO"))).otherwise(F.try_element_at("at", F.lit("ITEM NAME"))))
    return X.null_if_blank(c)


def import_so_master(grid: DataFrame, aliases: DataFrame, brand: str, fy: str) -> DataFrame:
    """Order master rows of a grid: party and type are required, rows without a party go, a party's last row stays."""
    heads = header_cells(grid)
    good = validate_headers(heads, aliases, ["PARTY NAME", "TYPE OF ORDER"]).where("valid").select("sheet", "rn")
    rows = data_rows(grid, header_index(heads.join(good, ["sheet", "rn"]), aliases))
    got = rows.select("sheet", "rn", X.norm_key(F.try_element_at("at", F.lit("PARTY NAME"))).alias("party_name"), F.lit(brand).alias("brand"), F.lit(fy).alias("fy"), X.norm_key(X.clean_type(F.try_element_at("at", F.lit("TYPE OF ORDER")))).alias("type_of_order")).where("party_name <> ''")
    return got.groupBy("party_name", "brand", "fy").agg(F.max_by("type_of_order", F.struct("sheet", "rn")).alias("type_of_order"))


def resume_skip(df: DataFrame, done: int) -> DataFrame:
    """Rows whose number is past done."""
    return df.where(F.col("number") > done)


#: Numbers of one block, in which row_cap() looks for the last row.
BLOCK = 65_536


def row_cap(df: DataFrame, n: int = 2_500_000) -> DataFrame:
    """The first n rows by number (which has no ties), a limit of the import itself. Numbers may have gaps, so rows are counted, by
    blocks of numbers; only the numbers of the block where the n-th row lies are put in order, and rows are not moved."""
    if n <= 0:
        return df.where(F.lit(False))
    block = F.floor(F.col("number") / BLOCK)
    sizes = df.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))  # a row a block
    ends = sizes.withColumn("_end", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    edge = ends.where((F.col("_end") >= n) & (F.col("_end") - F.col("_n") < n)).select("_b", (n - F.col("_end") + F.col("_n")).alias("_left"))
    inside = df.select("number", block.alias("_b")).join(F.broadcast(edge), "_b").withColumn("_place", F.row_number().over(Window.partitionBy("_b").orderBy("number")))
    last = inside.where(F.col("_place") <= F.col("_left")).agg(F.max("number").alias("_cut"))  # null: there are fewer
    return df.crossJoin(F.broadcast(last)).where(F.coalesce(F.col("number") <= F.col("_cut"), F.lit(True))).drop("_cut")


def keep(df: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """One row of each key, the last or first in the order, by a partial aggregate: a hot key is no single task's group."""
    take = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(take(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)
