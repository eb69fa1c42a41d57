"""Scalar functions of the sales model: built-in column expressions only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BRAND_ALIASES = {
    "D&J": "DON AND JULIO", "DNJ": "DON AND JULIO", "DON & JULIO": "DON AND JULIO", "DON AND JULIO": "DON AND JULIO",
    "IC": "ITALIAN CHANNEL", "ITALIAN CHANNEL": "ITALIAN CHANNEL",
    "RF": "RISHAB FABRICS", "RISHAB FABRICS": "RISHAB FABRICS",
    "VERCELLI": "VERCELLI",
}
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def null_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*(null_if_blank(c) for c in cols))


def _fy_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def _fy_start_of_date(c: Column) -> Column:
    return F.year(F.add_months(c, -3))


def fy_of_date(c: Column) -> Column:
    """Indian fiscal year (April to March) as YYYY-YY."""
    return _fy_label(_fy_start_of_date(c))


def month_label(c: Column) -> Column:
    return F.date_format(c, "MMM-yy")


def mmm_label(c: Column) -> Column:
    return F.upper(F.date_format(c, "MMM"))


def _fy_start_of_month_text(month: Column) -> Column:
    """First year of a label's fiscal year; null for labels of another form."""
    four, two = (F.regexp_extract(month, rf"^\s*[A-Za-z]{{3,9}}\s*[-/]\s*{d}\s*$", 1).try_cast("int") for d in (r"(\d{4})", r"\d?(\d{2})"))
    late = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, int(i < 3))))
    return F.coalesce(four, two + 2000) - F.try_element_at(late, F.upper(F.substring(F.trim(month), 1, 3)))


def _fy_start_axis() -> Column:
    return F.coalesce(_fy_start_of_date(F.col("bill_date")), _fy_start_of_month_text(F.col("month")))


def fy_axis() -> Column:
    return F.coalesce(null_if_blank(F.col("fy")), _fy_label(_fy_start_axis()))


def month_axis() -> Column:
    return F.coalesce(null_if_blank(F.col("month")), month_label(F.col("bill_date")))


def mmm_axis() -> Column:
    return null_if_blank(F.col("mmm"))


AXES = {"fy": fy_axis, "month": month_axis, "mmm": mmm_axis}
DATES = ("bill_date", "sale_order_date", "created_at")
MEASURES = ("rate_unit", "sl_qty", "units_pack", "gross_amount", "amount_before_tax", "net_amount")


def dim_axis(field: str) -> Column:
    if field in AXES:
        return AXES[field]()
    return F.col(field).cast("date") if field in DATES else null_if_blank(F.col(field).cast("string"))


def axis_label(field: str) -> Column:
    return F.coalesce(dim_axis(field).cast("string"), F.lit("(blank)"))


def axis_parts(field: str) -> list[Column]:
    """What tells axis_label() of a row, for label_of_parts(). Rows are grouped by it, so that a label that takes long to make is made
    once a group. Pivots compile all that they do to a row into one method, and the JVM only interprets methods of over 8000 bytes."""
    if field != "fy":
        return [axis_label(field)]
    text = null_if_blank(F.col("fy"))
    return [text, F.when(text.isNull(), _fy_start_axis())]


def label_of_parts(field: str, parts: list[Column]) -> Column:
    return F.coalesce(parts[0], _fy_label(parts[1]), F.lit("(blank)")) if field == "fy" else parts[0]


def goods_type(c: Column) -> Column:
    head = F.regexp_extract(F.upper(F.regexp_replace(F.trim(c), "^['\"]+", "")), "^([A-Z]+)", 1)
    known = F.when(head.isin("MID", "MIX", "SRC"), head).when(head.isin("ACS", "ACC"), "ACC").otherwise("Fresh")
    return F.when(null_if_blank(c).isNotNull(), known)


def item_with_shade(item: Column, shade: Column) -> Column:
    return F.nullif(F.concat_ws(" ", null_if_blank(item), null_if_blank(shade)), F.lit(""))


def canonical_brand(c: Column) -> Column:
    b = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    table = F.create_map(*(F.lit(x) for kv in BRAND_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, b), b)


def branch_rule(branch: Column, brand: Column) -> Column:
    return F.when((F.upper(F.trim(brand)) == "RARE WOOL") & (F.upper(F.trim(branch)) == "DON AND JULIO"), "RARE WOOL").otherwise(branch)


def norm_key(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def normalize_header(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"\x{A0}", " ")), r"\.", ""), r"\s+", " ")))


def normalize_header_dots(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, r"\x{A0}", " "), r"\s+", " ")))


def normalize_party(c: Column) -> Column:
    t = F.regexp_replace(c, r"\x{A0}", " ")
    t = F.regexp_replace(t, r"[\x{2010}-\x{2015}\x{2212}]", "-")
    t = F.regexp_replace(t, r"\s*-\s*", " - ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def strip_ms(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^m/s\.?\s*", ""), r"(?i)^ms\.?\s*", "")


def party_alias_keys(c: Column) -> Column:
    """The normalised name without its M/S prefix, where that differs from the normalised name."""
    alias = normalize_party(strip_ms(c))
    return F.when((alias != normalize_party(c)) & (alias != ""), alias)


def party_filter_values(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.array_distinct(F.array(t, F.trim(strip_ms(t))))


def agent_exact_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def agent_norm_key(c: Column) -> Column:
    return normalize_party(F.regexp_replace(c, r"\.", ""))


def backfill_key(c: Column) -> Column:
    t = F.regexp_replace(F.lower(c), r"\s+", " ")
    t = F.regexp_replace(t, r"\s*-\s*", "-")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9 \-]", ""))


def clean_type(c: Column) -> Column:
    t = F.regexp_replace(c, r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def fact_numeric(field: str) -> Column:
    c = F.col(field)
    if field != "units_pack":
        return c.cast("decimal(15,4)")
    t = F.trim(F.regexp_replace(c, ",", ""))
    return F.when(t.rlike(r"^[-+]?\d+(\.\d*)?$"), F.regexp_replace(t, r"\.$", "").try_cast("decimal(15,4)"))


def money_cell(c: Column) -> Column:
    """Digits, dot and minus of a cell; a cell without any is 0, an unreadable rest is null."""
    t = F.regexp_replace(c, r"[^0-9.\-]", "")
    return F.when(t == "", F.lit(0).cast("double")).otherwise(t.try_cast("double"))


def serial_to_date(c: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(c.try_cast("double")).cast("int"))


def parse_date_cell(c: Column) -> Column:
    t = F.trim(c)
    number = t.try_cast("double")
    parsed = [F.try_to_date(F.when(t.rlike(p), t), f) for p, f in ((r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"))]
    serial = F.when(t.rlike(r"^\d+(\.\d+)?$") & (number >= 32) & (number <= 2958465), serial_to_date(t))
    rest = [F.try_to_date(F.when(t.rlike(p), t), f) for p, f in ((r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"), (r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"))]
    d = F.coalesce(*parsed, serial, *rest)
    return F.when(F.year(d) >= 2000, d)


def valid_iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), "yyyy-MM-dd").isNotNull(), F.lit(False))


def iso_day(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


#: Order of texts that ignores case and accents.
BASE_ORDER = "UNICODE_CI_AI"


def natural_sort_key(c: Column) -> Column:
    """Text that sorts without regard to case and accents, and by the value of numbers inside. Numbers of over 40 digits sort by
    their first 40."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.collate(F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.ltrim(x, F.lit("0")), 40, "0")).otherwise(x)), ""), BASE_ORDER)


def round_half_up(c: Column, p: int = 0) -> Column:
    return F.round(c.cast("decimal(30,8)"), p)


def format_indian(c: Column) -> Column:
    return F.regexp_replace(round_half_up(c).cast("decimal(30,0)").cast("string"), r"(?<=\d)(?=(\d{2})*\d{3}$)", ",")


def derive_group_name(c: Column) -> Column:
    got = F.regexp_extract(F.trim(c), r"^(.+?)\s+-\s*[\w\s]+$", 1)
    return F.when(got != "", F.trim(got)).otherwise(F.trim(c))


def fy_range(label: str) -> tuple[str, str] | None:
    """First day and the day after the last of a label from 2000 to 2100; None for others."""
    import re

    m = re.fullmatch(r"(\d{4})-(\d{2})", label.strip())
    if not m or not 2000 <= int(m[1]) <= 2100 or (int(m[1]) + 1) % 100 != int(m[2]):
        return None
    return f"{m[1]}-04-01", f"{int(m[1]) + 1}-04-01"


def month_year(c: Column) -> Column:
    """Struct (y, m) of a label such as Apr-25 or April/2025; null for others."""
    t = F.trim(c)
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.substring(t, 1, 3)))
    digits = F.regexp_extract(t, r"(\d+)$", 1)
    n = digits.try_cast("int")
    year = F.when(n < 100, n + 2000).otherwise(n)
    return F.when(t.rlike(r"^[A-Za-z]{3,9}\s*[-/]\s*(\d{2}|\d{4})$") & (at > 0), F.struct(year.alias("y"), at.cast("int").alias("m")))


def month_only(c: Column) -> Column:
    """Number of a month name without a year; null for others."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.substring(F.trim(c), 1, 3)))
    return F.when(~c.rlike(r"[-/]\d") & (at > 0), at.cast("int"))


def fy_start(c: Column) -> Column:
    """First year of a YYYY-YY label, with any sign between and two to four last digits; null for others."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}\D\d{2,4}$"), F.substring(t, 1, 4).try_cast("int"))


def fy_to_range(c: Column) -> Column:
    """Struct (lo, hi): first day of a label's year and of the next; null outside 2000 to 2100 or for wrong labels."""
    y = F.when(F.trim(c).rlike(r"^\d{4}-\d{2}$"), fy_start(c))
    good = y.between(2000, 2100) & ((y + 1) % 100 == F.right(F.trim(c), F.lit(2)).try_cast("int"))
    return F.when(good, F.struct(F.make_date(y, F.lit(4), F.lit(1)).alias("lo"), F.make_date(y + 1, F.lit(4), F.lit(1)).alias("hi")))


def triple(y: Column, m: Column) -> Column:
    """Struct (fy, month, mmm) of a year and a month number; null where either is."""
    name = F.initcap(F.get(F.array(*map(F.lit, MONTHS)), m - 1))
    start = y - F.when(m < 4, 1).otherwise(0)
    fy = F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))
    return F.when(y.isNotNull() & m.isNotNull(), F.struct(fy.alias("fy"), F.concat(name, F.lit("-"), F.right(y.cast("string"), F.lit(2))).alias("month"), F.upper(name).alias("mmm")))


def date_triple(d: Column) -> Column:
    """triple() of a date from 2000 on; null for earlier dates."""
    return F.when(F.year(d) >= 2000, triple(F.year(d), F.month(d)))


def temporal_triple() -> Column:
    """triple() of bill_date, else of the month label."""
    label = month_year(F.col("month"))
    return F.coalesce(date_triple(F.col("bill_date")), triple(label["y"], label["m"]))


def temporal_fallback_numeric() -> Column:
    """triple() of bill_date, else of sale_order_date where there is none; else of a numeric month within the stored fy."""
    d = F.coalesce(F.col("bill_date"), F.col("sale_order_date"))
    number, start = F.col("month").try_cast("double"), F.when(F.trim("fy").rlike(r"^\d{4}-\d{2}$"), fy_start(F.col("fy")))
    m = F.when(number.between(1, 12) & (number == F.floor(number)), number.cast("int"))
    return F.coalesce(date_triple(d), triple(start + F.when(m < 4, 1).otherwise(0), m))


def fill_temporal(name: str) -> Column:
    """fy, month or mmm as stored, filled from bill_date where blank."""
    return F.coalesce(null_if_blank(F.col(name)), triple(F.year("bill_date"), F.month("bill_date"))[name])


def join_key(*cols: Column) -> Column:
    return F.concat_ws("||", *(F.coalesce(c.cast("string"), F.lit("(blank)")) for c in cols))


def split_key(c: Column, n: int) -> Column:
    """n labels of a key; missing ones are empty."""
    parts = F.split(c, r"\|\|")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(parts, i), F.lit("")))


def json_payload(*names: str) -> Column:
    return F.to_json(F.struct(*names))


def nfkc(c: Column) -> Column:
    """Unicode NFKC of a text column, by batches: Spark has no built-in for it. Null stays null."""
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.str.normalize("NFKC")

    return run(c)


def party_exact_key(c: Column) -> Column:
    """Name for exact matches: NFKC, Unicode dashes and blanks made plain, trimmed, upper case; inner blanks are kept."""
    t = F.regexp_replace(nfkc(c), r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\t\r\n]", " ")
    return F.upper(F.trim(F.regexp_replace(t, r"[\x{2010}-\x{2015}\x{2212}]", "-")))
