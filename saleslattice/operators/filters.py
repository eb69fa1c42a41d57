"""Filters of pivots and grids, as predicates that reach the scan where the column is compared as stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Text fields compared as stored.
EXACT = ("branch", "fy", "month", "mmm", "region", "state", "brand", "business_type")
PARTY = ("to_party_name",)


def not_total_pivot() -> Column:
    """One pattern, so that branch, which may be long to make, is made once a row."""
    return ~F.lower(F.trim(F.coalesce(F.col("branch"), F.lit("")))).rlike(r"\Atotal\z|grand ?total")


def is_total_grid(cols: list[str]) -> Column:
    cells = F.array(*(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in cols))
    return F.exists(cells, lambda x: (x == "total") | x.contains("grand total") | x.contains("grandtotal"))


def _text(field: str) -> Column:
    return F.trim(F.coalesce(F.col(field).cast("string"), F.lit("")))


def _fy_in(values: list[str]) -> Column | None:
    spans = [X.fy_range(v) for v in values]
    d = F.col("bill_date")
    ok = [(d >= F.lit(a).cast("date")) & (d < F.lit(b).cast("date")) for a, b in filter(None, spans)]
    return reduce(lambda a, b: a | b, ok) if ok else None


def predicate(field: str, op: str, value=None, values=None, casefold: bool = False) -> Column | None:
    """None where the filter is dropped: unknown operator, nothing to compare with, an unreadable number or date."""
    number, date = field in X.MEASURES, field in X.DATES
    vals = [str(v).strip() for v in (values if values is not None else [] if value is None else [value]) if v is not None and str(v).strip() != ""]
    c = F.col(field)
    if op == "is_blank":
        return c.isNull() if date else c.isNull() | (F.trim(c.cast("string")) == "")
    if op == "is_not_blank":
        return c.isNotNull() if date else c.isNotNull() & (F.trim(c.cast("string")) != "")
    if op == "contains":
        return F.lower(c.cast("string")).contains(vals[0].lower()) if vals else None
    if casefold and op in ("in", "eq"):
        return F.lower(_text(field)).isin([v.lower() for v in vals]) if vals else predicate(field, "is_blank")
    if op == "eq" and not vals:
        return predicate(field, "is_blank")
    if not vals:
        return None
    if field == "id":
        return _text(field).isin(vals) if op in ("in", "eq") else None
    if number:
        nums = []
        for v in vals:
            try:
                nums.append(F.lit(v.replace(",", "")).cast("decimal(15,4)") if float(v.replace(",", "")) is not None else None)
            except ValueError:
                continue
        left = X.fact_numeric(field)
        if not nums:
            return None
    elif date:
        left, nums = c.cast("date"), [F.lit(v[:10]).cast("date") for v in vals]
    else:
        left, nums = F.lower(F.trim(c)), [F.lit(vals[0].lower())]
    if op in ("gt", "gte", "lt", "lte"):
        return {"gt": left > nums[0], "gte": left >= nums[0], "lt": left < nums[0], "lte": left <= nums[0]}[op]
    if op not in ("in", "eq"):
        return None
    if number or date:
        return left.isin(nums)
    if field == "fy" and (p := _fy_in(vals)) is not None:
        return p
    if field in PARTY:
        return X.norm_key(c).isin(vals)
    return c.isin(vals) if field in EXACT else _text(field).isin(vals)


def where(filters: list[dict] | dict, exclude_totals: bool = True, casefold: bool = False) -> Column:
    if isinstance(filters, dict):
        filters = [{"field": k, **v} for k, v in filters.items()]
    got = [predicate(f["field"], f.get("operator", "eq"), f.get("value"), f.get("values"), casefold) for f in filters]
    parts = [p for p in got if p is not None] + ([not_total_pivot()] if exclude_totals else [])
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search_parties(groups: DataFrame, term: str) -> DataFrame:
    """p: names, with and without M/S prefix, of the parties whose group contains the term."""
    hit = groups.where(F.lower("party_grouped").contains(term.lower())).where("to_party_name IS NOT NULL")
    name = F.col("to_party_name")
    return hit.select(F.explode(F.concat(F.array(name), X.party_filter_values(name))).alias("p")).distinct()


def search(df: DataFrame, groups: DataFrame, term: str = "", state: str = "") -> DataFrame:
    """Rows of a state (any if blank) whose bill number, group or, from three characters on, party's group has the term.
    Here % and _ stay wildcards. All matching parties count; the join takes their number as it comes."""
    term, state = term.strip(), state.strip()
    out = df.where(F.col("state") == state) if state else df
    if len(term) < 2:
        return out
    found = F.coalesce(F.col("bill_no").ilike(f"%{term}%"), F.lit(False)) | F.coalesce(F.col("party_grouped").ilike(f"%{term}%"), F.lit(False))
    if len(term) < 3:
        return out.where(found)
    names = search_parties(groups, term).withColumnRenamed("p", "_p")
    return out.join(names, F.col("to_party_name") == F.col("_p"), "left").where(found | F.col("_p").isNotNull()).drop("_p")


#: Columns in which a grid's totals are looked for.
TOTAL_COLUMNS = ("branch", "item_no", "to_party_name", "party_name_for_count", "party_grouped", "agent_names_correction", "brand")


def not_total_grid(df: DataFrame) -> Column:
    return ~is_total_grid([c for c in TOTAL_COLUMNS if c in df.columns])


def date_range(df: DataFrame, first: str, last: str, field: str = "bill_date") -> DataFrame:
    """Rows of the days from first to last."""
    return df.where(F.col(field).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def missing_lookup(df: DataFrame, field: str = "district") -> DataFrame:
    """Rows for which a lookup found nothing: the field is null or empty."""
    return df.where(F.col(field).isNull() | (F.col(field) == ""))


def count_filtered(df: DataFrame, filters: list[dict] | dict, exclude_totals: bool = False) -> DataFrame:
    return df.where(where(filters, exclude_totals)).agg(F.count(F.lit(1)).alias("n"))


def page_keyset(df: DataFrame, after: int, limit: int = 50) -> DataFrame:
    """The next rows by id."""
    return df.where(F.col("id") > after).orderBy("id").limit(limit)


def sort_page(df: DataFrame, by: str = "id", asc: bool = False, page: int = 1, limit: int = 50) -> DataFrame:
    """One page in the order of a column, nulls last; ids decide ties in the same direction."""
    order = [F.asc_nulls_last(by), F.asc("id")] if asc else [F.desc_nulls_last(by), F.desc("id")]
    return df.orderBy(*order).offset((max(page, 1) - 1) * limit).limit(limit)


def grid_page(df: DataFrame, groups: DataFrame, term: str = "", state: str = "", by: str = "id", asc: bool = False, page: int = 1, limit: int = 50) -> DataFrame:
    """One page of the searched rows, newest first, without its total rows."""
    limit = min(max(limit, 10), 300)
    rows = sort_page(search(df, groups, term, state), by, asc, page, limit)
    return rows.where(not_total_grid(rows))
