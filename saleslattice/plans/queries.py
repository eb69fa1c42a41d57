"""Registered queries of the sales model, each with the SQL that the oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import filters as W
from ..operators import history as H
from ..operators import lookups as L
from ..operators import maintain as M
from ..operators import rollups as R
from ..sources import scratch
from ..sources.facts import fy_part
from ..sources.fixtures import load, with_views
from . import pivot as P

NOT_TOTAL = "NOT (lower(trim(coalesce(branch,''))) IN ('total','grand total') OR contains(lower(trim(coalesce(branch,''))),'grand total') OR contains(lower(trim(coalesce(branch,''))),'grandtotal'))"


def _fy(d: str) -> str:
    y = f"(year({d}) - CASE WHEN month({d}) < 4 THEN 1 ELSE 0 END)"
    return f"CASE WHEN {d} IS NOT NULL THEN concat({y}, '-', lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0')) END"


MONTH_NO = "(list_position(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'], upper(substr(trim(month),1,3))))"
_Y = f"(2000 + CAST(right(month, 2) AS INT) - CASE WHEN {MONTH_NO} < 4 THEN 1 ELSE 0 END)"
FY_AXIS = f"coalesce(nullif(trim(fy),''), {_fy('bill_date')}, CASE WHEN regexp_matches(month, '^[A-Za-z]{{3}}-[0-9]{{2}}$') THEN concat({_Y}, '-', lpad(CAST(({_Y} + 1) % 100 AS VARCHAR), 2, '0')) END)"
MONTH_AXIS = "coalesce(nullif(trim(month),''), strftime(bill_date, '%b-%y'))"
BRAND = "CASE upper(trim(coalesce(brand,''))) WHEN 'D&J' THEN 'DON AND JULIO' WHEN 'DNJ' THEN 'DON AND JULIO' WHEN 'DON & JULIO' THEN 'DON AND JULIO' WHEN 'IC' THEN 'ITALIAN CHANNEL' WHEN 'RF' THEN 'RISHAB FABRICS' ELSE upper(trim(coalesce(brand,''))) END"


def _party(c: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({c}, '\\s*-\\s*', ' - ', 'g'), '\\s+', ' ', 'g')))"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace(trim({c}), '^m/s\\.?\\s*', '', 'i'), '^ms\\.?\\s*', '', 'i')"


UNITS = "CASE WHEN regexp_matches(trim(replace(units_pack, ',', '')), '^[-+]?\\d+(\\.\\d*)?$') THEN CAST(trim(replace(units_pack, ',', '')) AS DECIMAL(15,4)) END"
AGG = "count(*) AS n, coalesce(sum(net_amount), 0) AS total"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, run, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = with_views(sql, *(views or ("fx_sales",)))


def _total(df: DataFrame, cond) -> DataFrame:
    return df.where(cond).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("net_amount"), F.lit(0).cast("decimal(25,4)")).alias("total"))


def _filter(name: str, f: list[dict], sql: str, casefold: bool = False) -> None:
    add(name, lambda s, d: _total(load(s, d), W.where(f, casefold=casefold)), f"SELECT {AGG} FROM fx_sales WHERE {NOT_TOTAL} AND ({sql})")


_filter("f_total_rows_pivot", [], "true")
_filter("f_id_ops", [{"field": "id", "operator": "contains", "value": "77"}], "contains(CAST(id AS VARCHAR), '77')")
_filter("f_is_blank", [{"field": "state", "operator": "is_blank"}], "state IS NULL OR trim(state) = ''")
_filter("f_is_not_blank", [{"field": "bill_date", "operator": "is_not_blank"}], "bill_date IS NOT NULL")
_filter("f_in_fy", [{"field": "fy", "operator": "in", "values": ["2000-01", "bad"]}], "bill_date >= DATE '2000-04-01' AND bill_date < DATE '2001-04-01'")
_filter("f_eq_fy", [{"field": "fy", "operator": "eq", "value": "1999-00"}], "fy = '1999-00'")
_filter("f_in_numeric", [{"field": "sl_qty", "operator": "in", "values": ["5", "-7"]}], "sl_qty IN (5, -7)")
_filter("f_in_date", [{"field": "bill_date", "operator": "in", "values": ["1998-03-01", "1999-05-05"]}], "bill_date IN (DATE '1998-03-01', DATE '1999-05-05')")
_filter("f_in_party", [{"field": "to_party_name", "operator": "in", "values": ["CUSTOMER#000000001", "CUSTOMER#000000007"]}], "upper(trim(coalesce(to_party_name,''))) IN ('CUSTOMER#000000001','CUSTOMER#000000007')")
_filter("f_in_text_exact", [{"field": "branch", "operator": "in", "values": ["BR NATION_7", "BR NATION_11"]}], "branch IN ('BR NATION_7','BR NATION_11')")
_filter("f_in_text_trim", [{"field": "city", "operator": "in", "values": ["CITY BUILDING"]}], "trim(coalesce(city,'')) IN ('CITY BUILDING')")
_filter("f_contains", [{"field": "branch", "operator": "contains", "value": "an"}], "contains(lower(branch), 'an')")
_filter("f_cmp_numeric", [{"field": "units_pack", "operator": "gte", "value": "100"}], f"({UNITS}) >= 100")
_filter("f_cmp_date", [{"field": "bill_date", "operator": "lt", "value": "1997-01-01"}], "bill_date < DATE '1997-01-01'")
_filter("f_cmp_text", [{"field": "city", "operator": "gt", "value": "CITY F"}], "lower(trim(city)) > 'city f'")
_filter("f_eq_numeric", [{"field": "net_amount", "operator": "eq", "value": ""}], "net_amount IS NULL")
_filter("f_eq_date", [{"field": "bill_date", "operator": "eq", "value": "1998-03-01"}], "bill_date = DATE '1998-03-01'")
_filter("f_eq_text", [{"field": "state", "operator": "eq", "value": "NATION_7"}], "state = 'NATION_7'")
_filter("f_casefold", [{"field": "state", "operator": "eq", "value": "nation_7"}], "lower(trim(coalesce(state,''))) = 'nation_7'", True)
_filter("f_fact_where", [{"field": "state", "operator": "in", "values": ["NATION_7", "NATION_11"]}, {"field": "sl_qty", "operator": "gt", "value": "10"}, {"field": "x", "operator": "nope", "value": "1"}], "state IN ('NATION_7','NATION_11') AND sl_qty > 10")
add("f_date_range", lambda s, d: _total(W.date_range(load(s, d), "1998-01-01", "1998-12-31"), F.lit(True)), f"SELECT {AGG} FROM fx_sales WHERE bill_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
add("f_total_rows_grid", lambda s, d: _total(df := load(s, d), W.not_total_grid(df)), f"SELECT {AGG} FROM fx_sales WHERE {NOT_TOTAL}")
add("f_missing_lookup", lambda s, d: _total(W.missing_lookup(load(s, d)), F.lit(True)), f"SELECT {AGG} FROM fx_sales WHERE district IS NULL OR district = ''")


def _derived(name: str, col, sql: str, *keys: str) -> None:
    keys = keys or ("bill_date",)
    add(name, lambda s, d: load(s, d).groupBy(*keys, col().alias("value")).agg(F.count(F.lit(1)).alias("n")), f"SELECT {', '.join(keys)}, {sql} AS value, count(*) AS n FROM fx_sales GROUP BY ALL")


_derived("fy_of_date", lambda: X.fy_of_date(F.col("bill_date")), _fy("bill_date"))
_derived("month_label", lambda: X.month_label(F.col("bill_date")), "strftime(bill_date, '%b-%y')")
_derived("mmm_label", lambda: X.mmm_label(F.col("bill_date")), "upper(strftime(bill_date, '%b'))")
_derived("fy_axis", X.fy_axis, FY_AXIS)
_derived("month_axis", X.month_axis, MONTH_AXIS)
_derived("mmm_axis", X.mmm_axis, "nullif(trim(mmm),'')")
_derived("dim_axis", lambda: X.dim_axis("branch"), "nullif(trim(branch),'')", "branch")
_derived("axis_label", lambda: X.axis_label("state"), "coalesce(nullif(trim(state),''),'(blank)')", "state")
_derived("fact_partition_key", lambda: fy_part(F.col("bill_date")), f"CASE WHEN bill_date >= DATE '2020-04-01' AND bill_date < DATE '2026-04-01' THEN {_fy('bill_date')} ELSE '__default__' END")
_derived("goods_type", lambda: X.goods_type(F.col("sale_order_no")), "CASE WHEN nullif(trim(sale_order_no),'') IS NULL THEN NULL ELSE CASE regexp_extract(upper(regexp_replace(trim(sale_order_no), '^[''\"]+', '')), '^([A-Z]+)', 1) WHEN 'MID' THEN 'MID' WHEN 'MIX' THEN 'MIX' WHEN 'SRC' THEN 'SRC' WHEN 'ACS' THEN 'ACC' WHEN 'ACC' THEN 'ACC' ELSE 'Fresh' END END", "sale_order_no")
_derived("item_with_shade", lambda: X.item_with_shade(F.col("item_no"), F.col("shade_name")), "nullif(concat_ws(' ', nullif(trim(item_no),''), nullif(trim(shade_name),'')),'')", "item_no")
_derived("canonical_brand", lambda: X.canonical_brand(F.col("brand")), BRAND, "brand")
_derived("branch_rule", lambda: X.branch_rule(F.col("branch"), F.col("brand")), "CASE WHEN upper(trim(brand)) = 'RARE WOOL' AND upper(trim(branch)) = 'DON AND JULIO' THEN 'RARE WOOL' ELSE branch END", "branch")
_derived("item_sub_cat_fallback", lambda: X.first_non_blank(F.col("item_sub_cat"), F.col("scheme")), "coalesce(nullif(trim(item_sub_cat),''), nullif(trim(scheme),''))", "item_sub_cat")
_derived("norm_keys", lambda: X.norm_key(F.col("to_party_name")), "upper(trim(coalesce(to_party_name,'')))", "to_party_name")
_derived("normalize_party", lambda: X.normalize_party(F.col("to_party_name")), _party("to_party_name"), "to_party_name")
_derived("party_alias_keys", lambda: X.party_alias_keys(F.col("to_party_name")), f"CASE WHEN {_party(_strip('to_party_name'))} <> {_party('to_party_name')} THEN {_party(_strip('to_party_name'))} END", "to_party_name")
_derived("agent_exact_key", lambda: X.agent_exact_key(F.col("agent_name")), "lower(trim(regexp_replace(agent_name, '\\s+', ' ', 'g')))", "agent_name")
_derived("agent_norm_key", lambda: X.agent_norm_key(F.col("agent_name")), _party("replace(agent_name, '.', '')"), "agent_name")
_derived("backfill_key", lambda: X.backfill_key(F.col("agent_name")), "trim(regexp_replace(lower(agent_name), '[^a-z0-9 \\-]', '', 'g'))", "agent_name")
_derived("normalize_header", lambda: X.normalize_header(F.col("agent_name")), "upper(trim(replace(agent_name, '.', '')))", "agent_name")
_derived("normalize_header_dots", lambda: X.normalize_header_dots(F.col("agent_name")), "upper(trim(agent_name))", "agent_name")
_derived("fact_numeric", lambda: X.fact_numeric("units_pack"), UNITS, "units_pack")
_derived("money_cell", lambda: X.money_cell(F.col("units_pack")), "CASE WHEN regexp_replace(units_pack, '[^0-9.\\-]', '', 'g') = '' THEN 0.0::DOUBLE ELSE TRY_CAST(regexp_replace(units_pack, '[^0-9.\\-]', '', 'g') AS DOUBLE) END", "units_pack")
_derived("serial_to_date", lambda: X.serial_to_date(F.col("size")), "DATE '1899-12-30' + CAST(size AS INT)", "size")
_derived("round_half_up", lambda: X.round_half_up(F.col("net_amount")).cast("decimal(20,0)"), "CAST(round(net_amount) AS DECIMAL(20,0))", "net_amount")
_derived("natural_sort_key", lambda: X.natural_sort_key(F.col("item_no")).cast("string"), "concat('item ', lpad(regexp_extract(item_no, '(\\d+)', 1), 40, '0'))", "item_no")
_derived("first_non_blank", lambda: X.first_non_blank(F.col("state"), F.col("city")), "coalesce(nullif(trim(state),''), nullif(trim(city),''))", "state", "city")
_derived("iso_day", lambda: X.iso_day(F.col("bill_date").cast("string")), "bill_date")
_derived("valid_iso_date", lambda: X.valid_iso_date(F.col("bill_date").cast("string")), "bill_date IS NOT NULL")
_derived("format_indian", lambda: X.format_indian(F.col("sl_qty") * 1000), "CASE WHEN abs(sl_qty) >= 100 THEN NULL ELSE concat(CAST(CAST(sl_qty AS INT) AS VARCHAR), ',000') END", "sl_qty")

for _f, _a, _e in (("net_amount", "sum", "coalesce(sum(net_amount),0)"), ("net_amount", "count", "count(*)"), ("net_amount", "avg", "CAST(coalesce(sum(net_amount),0) AS DOUBLE) / count(*)"), ("rate_unit", "min", "min(rate_unit)"), ("sl_qty", "max", "max(sl_qty)")):
    add(f"agg_{_a}", lambda s, d, c=P.config(["brand"], [], [(_f, _a)]): P.pivot_groupby(load(s, d), c), f"SELECT nullif(trim(brand),'') AS d_brand, {_e} AS {_a}_{_f}, count(*) AS row_count FROM fx_sales WHERE {NOT_TOTAL} GROUP BY 1")
_G = P.config(["branch", "brand"], [], [("net_amount", "sum")], [{"field": "fy", "operator": "in", "values": ["2000-01"]}])
add("pivot_groupby", lambda s, d: P.pivot_groupby(load(s, d), _G), f"SELECT nullif(trim(branch),'') AS d_branch, nullif(trim(brand),'') AS d_brand, coalesce(sum(net_amount),0) AS sum_net_amount, count(*) AS row_count FROM fx_sales WHERE {NOT_TOTAL} AND bill_date >= DATE '2000-04-01' AND bill_date < DATE '2001-04-01' GROUP BY 1, 2")
add("pivot_global", lambda s, d: P.pivot_groupby(load(s, d), P.config([], [], [("net_amount", "sum"), ("units_pack", "sum")])), f"SELECT coalesce(sum(net_amount),0) AS sum_net_amount, coalesce(sum({UNITS}),0) AS sum_units_pack, count(*) AS row_count FROM fx_sales WHERE {NOT_TOTAL}")
_T = P.config(["state", "brand"], ["fy"], [("net_amount", "sum"), ("sl_qty", "avg"), ("id", "count")], subtotals=["state"])


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({"row_labels": F.array_join("row_labels", "||"), "col_labels": F.array_join("col_labels", "||")})


_SETS = f"""WITH b AS (SELECT *, coalesce(nullif(trim(state),''),'(blank)') AS r1, coalesce(nullif(trim(brand),''),'(blank)') AS r2, coalesce({FY_AXIS},'(blank)') AS c1 FROM fx_sales WHERE {NOT_TOTAL}),
g AS (SELECT r1, r2, c1, coalesce(sum(net_amount),0) AS sum_net_amount, CAST(coalesce(sum(sl_qty),0) AS DOUBLE) / count(*) AS avg_sl_qty, count(*) AS count_id FROM b GROUP BY GROUPING SETS ((r1,r2,c1),(r1,r2),(r1,c1),(r1),(c1),()))
SELECT CASE WHEN r2 IS NOT NULL AND c1 IS NOT NULL THEN 'cell' WHEN r2 IS NOT NULL THEN 'row_total' WHEN r1 IS NULL AND c1 IS NOT NULL THEN 'column_total' WHEN r1 IS NULL THEN 'grand_total' WHEN c1 IS NOT NULL THEN 'subtotal' ELSE 'subtotal_total' END AS kind,
CAST((r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT AS INT) AS depth, concat_ws('||', r1, r2) AS row_labels, coalesce(c1, '') AS col_labels, sum_net_amount, avg_sl_qty, count_id FROM g"""
add("pivot_totals_onepass", lambda s, d: _flat(P.pivot(load(s, d), _T)), _SETS)
for _n, _k in (("pivot_row_totals", "row_total"), ("pivot_column_totals", "column_total"), ("pivot_grand_total", "grand_total"), ("pivot_subtotals", "subtotal")):
    add(_n, lambda s, d, k=_k: _flat(P.pivot(load(s, d), _T)).where(F.col("kind") == k), f"SELECT * FROM ({_SETS.replace('WITH b AS', 'WITH b AS', 1)}) WHERE kind = '{_k}'")
add("pivot_quick", lambda s, d: P.pivot_quick(load(s, d), "region"), f"SELECT nullif(trim(region),'') AS d_region, coalesce(sum(net_amount),0) AS sum_net_amount, count(*) AS row_count FROM fx_sales WHERE {NOT_TOTAL} GROUP BY 1")
add("filtered_row_count", lambda s, d: P.pivot_groupby(load(s, d), _G).agg(F.sum("row_count").alias("n")), f"SELECT count(*) AS n FROM fx_sales WHERE {NOT_TOTAL} AND bill_date >= DATE '2000-04-01' AND bill_date < DATE '2001-04-01'")
add("drilldown", lambda s, d: P.drilldown(load(s, d), P.config([], [], [("id", "count")]), {"state": "NATION_7", "brand": "VERCELLI"}).select("id", "bill_no", "net_amount"), f"SELECT id, bill_no, net_amount FROM fx_sales WHERE {NOT_TOTAL} AND trim(coalesce(state,'')) = 'NATION_7' AND trim(coalesce(brand,'')) = 'VERCELLI' ORDER BY id LIMIT 200")
add("distinct_values", lambda s, d: P.distinct_values(load(s, d), "branch", "an"), "SELECT DISTINCT trim(branch) AS value FROM fx_sales WHERE trim(branch) <> '' AND contains(lower(trim(branch)), 'an')")
_FIELDS = ["branch", "brand", "state", "city", "mmm", "region", "district", "business_type", "party_grouped", "to_party_name", "agent_name", "bill_no", "item_no", "shade_name", "size", "units_pack", "sale_order_no", "item_category", "item_sub_cat", "so_type", "scheme"]
add("distinct_values_batch", lambda s, d: P.distinct_values_batch(load(s, d), [*_FIELDS, "fy", "month", "nope"]), "SELECT field, value, CAST(NULL AS VARCHAR) AS error FROM (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY lower(value), value) AS n FROM (" + " UNION ".join([f"SELECT '{c}' AS field, trim({c}) AS value FROM fx_sales WHERE trim({c}) <> ''" for c in _FIELDS] + [f"SELECT '{c}' AS field, {x} AS value FROM fx_sales WHERE {x} IS NOT NULL" for c, x in (("fy", FY_AXIS), ("month", MONTH_AXIS))]) + ") v) w WHERE n <= 500 UNION ALL SELECT 'nope', NULL, 'Invalid filter field'")
add("distinct_states", lambda s, d: P.distinct_states(load(s, d)), "SELECT DISTINCT state FROM fx_sales WHERE trim(state) <> ''")
add("count_filtered", lambda s, d: W.count_filtered(load(s, d), {"state": {"operator": "eq", "value": "NATION_7"}}), "SELECT count(*) AS n FROM fx_sales WHERE state = 'NATION_7'")
add("page_keyset", lambda s, d: W.page_keyset(load(s, d), 5_000_000_000).select("id"), "SELECT id FROM fx_sales WHERE id > 5000000000 ORDER BY id LIMIT 50")
add("page_offset", lambda s, d: W.sort_page(load(s, d), page=3).select("id"), "SELECT id FROM fx_sales ORDER BY id DESC LIMIT 50 OFFSET 100")
add("sort_grid_page", lambda s, d: W.sort_page(load(s, d), "net_amount").select("id", "net_amount"), "SELECT id, net_amount FROM fx_sales ORDER BY net_amount DESC NULLS LAST, id DESC LIMIT 50")
add("axis_cardinality", lambda s, d: P.axis_cardinality(load(s, d), ["branch", "to_party_name", "item_no"]), "SELECT count(DISTINCT branch) AS branch, count(DISTINCT to_party_name) AS to_party_name, count(DISTINCT item_no) AS item_no, CAST(count(DISTINCT branch) * count(DISTINCT to_party_name) * count(DISTINCT item_no) AS BIGINT) AS cells FROM fx_sales")
add("report_meta", lambda s, d: P.report_meta(load(s, d)).withColumn("months", F.array_join("months", "|")), f"SELECT fy, string_agg(m, '|' ORDER BY o, m) AS months FROM (SELECT DISTINCT {FY_AXIS} AS fy, {MONTH_AXIS} AS m, coalesce(list_position(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'], upper(substr({MONTH_AXIS}, 1, 3))), 99) AS o FROM fx_sales) x WHERE fy IS NOT NULL AND m IS NOT NULL GROUP BY 1")

for _n, _d in R.ROLLUPS.items():
    if "agent_name_final" in _d:
        continue
    _s = ", ".join("CAST(date_trunc('month', bill_date) AS DATE) AS bill_month" if c == "bill_month" else c for c in _d)
    add(f"rollup_{_n}", lambda s, d, n=_n: R.rollup(load(s, d), n), f"SELECT {_s}, sum(net_amount) AS total_net, sum(amount_before_tax) AS total_before_tax, sum(sl_qty) AS total_qty, count(*) AS fact_row_count FROM fx_sales WHERE {NOT_TOTAL} GROUP BY {', '.join(str(i + 1) for i in range(len(_d)))}")
_V = [("net_amount", "sum"), ("sl_qty", "avg"), ("id", "count")]
_VALUES = f"coalesce(sum(net_amount),0) AS sum_net_amount, CAST(coalesce(sum(sl_qty),0) AS DOUBLE) / count(*) AS avg_sl_qty, count(*) AS count_id FROM fx_sales WHERE {NOT_TOTAL}"
add("reaggregate_rollup", lambda s, d: R.reaggregate(R.rollup(load(s, d), "state_party_brand"), ["state", "brand"], _V), f"SELECT nullif(trim(state),'') AS d_state, nullif(trim(brand),'') AS d_brand, {_VALUES} GROUP BY 1, 2")



_SO = "fx_so_master"
add("lookup_region", lambda s, d: L.lookup_region(load(s, d), load(s, d, "fx_region_master")).groupBy("state", "region").agg(F.count(F.lit(1)).alias("n")), "SELECT s.state, coalesce(m.region, s.region) AS region, count(*) AS n FROM fx_sales s LEFT JOIN fx_region_master m ON upper(trim(coalesce(s.state,''))) = upper(trim(m.state)) GROUP BY 1, 2", "fx_sales", "fx_region_master")
add("lookup_party_master", lambda s, d: L.lookup_party_master(load(s, d), load(s, d, "fx_party_master_app")).groupBy("to_party_name", "district", "pin_code").agg(F.count(F.lit(1)).alias("n")), f"SELECT s.to_party_name, coalesce(m.district, s.district) AS district, coalesce(m.pin_code, s.pin_code) AS pin_code, count(*) AS n FROM fx_sales s LEFT JOIN fx_party_master_app m ON {_party(_strip('s.to_party_name'))} = {_party(_strip('m.account_name'))} GROUP BY 1, 2, 3", "fx_sales", "fx_party_master_app")
add("lookup_customer_type", lambda s, d: L.lookup_customer_type(load(s, d), load(s, d, "fx_customer_type_master")).groupBy("to_party_name", "master_type").agg(F.count(F.lit(1)).alias("n")), f"SELECT s.to_party_name, coalesce(m.type, 'RETAILER') AS master_type, count(*) AS n FROM fx_sales s LEFT JOIN fx_customer_type_master m ON {_party(_strip('s.to_party_name'))} = {_party('m.party_name')} GROUP BY 1, 2", "fx_sales", "fx_customer_type_master")
add("lookup_party_group", lambda s, d: L.lookup_party_group(load(s, d), load(s, d, "fx_party_grouping_master")).groupBy("to_party_name", "party_grouped").agg(F.count(F.lit(1)).alias("n")), f"SELECT s.to_party_name, CASE WHEN m.id IS NULL THEN trim(s.to_party_name) ELSE coalesce(m.party_grouped, s.party_grouped, trim(s.to_party_name)) END AS party_grouped, count(*) AS n FROM fx_sales s LEFT JOIN fx_party_grouping_master m ON {_party(_strip('s.to_party_name'))} = {_party('m.to_party_name')} GROUP BY 1, 2", "fx_sales", "fx_party_grouping_master")
add("lookup_agent", lambda s, d: L.lookup_agent(load(s, d), load(s, d, "fx_agent_name_master")).groupBy("agent_name", "agent_name_final").agg(F.count(F.lit(1)).alias("n")), "SELECT s.agent_name, coalesce(m.combined_name, trim(s.agent_name)) AS agent_name_final, count(*) AS n FROM fx_sales s LEFT JOIN fx_agent_name_master m ON lower(replace(s.agent_name,'.','')) = lower(m.agent_name) GROUP BY 1, 2", "fx_sales", "fx_agent_name_master")
add("lookup_so_type_latest", lambda s, d: L.so_type_latest(load(s, d, _SO)), f"SELECT {_party('party_name')} AS party_key, arg_max(type_of_order, (so_order_date, id)) AS so_type FROM fx_so_master GROUP BY 1", _SO)


def _masters(s, d) -> dict:
    return {k: load(s, d, v) for k, v in (("region", "fx_region_master"), ("party", "fx_party_master_app"), ("group", "fx_party_grouping_master"), ("agent", "fx_agent_name_master"), ("type", "fx_customer_type_master"), ("so", _SO))}


def enriched(s, d) -> DataFrame:
    return L.enrich_fact(load(s, d), _masters(s, d))


_GOODS = "CASE WHEN nullif(trim(sale_order_no),'') IS NULL THEN NULL ELSE CASE regexp_extract(upper(regexp_replace(trim(sale_order_no), '^[''\"]+', '')), '^([A-Z]+)', 1) WHEN 'MID' THEN 'MID' WHEN 'MIX' THEN 'MIX' WHEN 'SRC' THEN 'SRC' WHEN 'ACS' THEN 'ACC' WHEN 'ACC' THEN 'ACC' ELSE 'Fresh' END END"
_LAST = "arg_max(type_of_order, (so_order_date, id))"
#: Every rule of the import, in its order, over the fact and all masters.
_ENRICHED = f"""WITH b AS (SELECT * REPLACE (CASE WHEN upper(trim(brand)) = 'RARE WOOL' AND upper(trim(branch)) = 'DON AND JULIO' THEN 'RARE WOOL' ELSE branch END AS branch, coalesce(nullif(trim(fy),''), {_fy('bill_date')}) AS fy, {MONTH_AXIS} AS month,
  coalesce(nullif(trim(mmm),''), upper(strftime(bill_date, '%b'))) AS mmm, {BRAND} AS brand), {_party('to_party_name')} AS pk, {_party(_strip('to_party_name'))} AS ak, trim(to_party_name) AS party FROM fx_sales),
k AS (SELECT b.* REPLACE (coalesce(r.region, b.region) AS region, coalesce(p.district, b.district) AS district, coalesce(p.pin_code, b.pin_code) AS pin_code,
    CASE WHEN g.id IS NULL THEN b.party ELSE coalesce(g.party_grouped, b.party_grouped, b.party) END AS party_grouped, coalesce(g.party_name_for_count, b.party_name_for_count, b.party) AS party_name_for_count),
  coalesce(a.combined_name, trim(b.agent_name)) AS agent_name_final, coalesce(a.combined_name, trim(b.agent_name)) AS agent_names_correction,
  nullif(concat_ws(' ', nullif(trim(b.item_no),''), nullif(trim(b.shade_name),'')),'') AS item_with_shade, coalesce(nullif(trim(b.business_type),''), t.type, 'RETAILER') AS kind, {_GOODS} AS goods_type, x.t AS exact, l.t AS latest
FROM b LEFT JOIN fx_region_master r ON upper(trim(coalesce(b.state,''))) = upper(trim(r.state)) LEFT JOIN fx_party_master_app p ON b.ak = {_party(_strip('p.account_name'))}
LEFT JOIN fx_party_grouping_master g ON b.ak = {_party('g.to_party_name')} LEFT JOIN fx_customer_type_master t ON b.ak = {_party('t.party_name')}
LEFT JOIN fx_agent_name_master a ON lower(replace(b.agent_name,'.','')) = lower(a.agent_name)
LEFT JOIN (SELECT upper(trim(party_name)) AS pn, upper(trim(brand)) AS bn, trim(fy) AS fn, {_LAST} AS t FROM {_SO} GROUP BY 1, 2, 3) x ON upper(b.party) = x.pn AND b.brand = x.bn AND b.fy = x.fn
LEFT JOIN (SELECT {_party('party_name')} AS pn, {_LAST} AS t FROM {_SO} GROUP BY 1) l ON b.pk = l.pn)
SELECT * EXCLUDE (pk, ak, party, kind, exact, latest) REPLACE (CASE WHEN upper(trim(branch)) = 'ITALIAN CHANNEL' AND upper(kind) = 'RETAILER' THEN 'DISTRIBUTOR' ELSE kind END AS business_type,
  CASE WHEN sl_qty <= 0 THEN 'RETURN' WHEN brand = 'RISHAB FABRICS' THEN 'NO SCHEME' ELSE coalesce(exact, latest, nullif(trim(so_type),''), 'UNKNOWN') END AS so_type) FROM k"""
_EV = ("fx_sales", "fx_region_master", "fx_party_master_app", "fx_party_grouping_master", "fx_customer_type_master", "fx_agent_name_master", _SO)
add("enrich_fact", enriched, _ENRICHED, *_EV)
add("so_type_rule", lambda s, d: enriched(s, d).groupBy("brand", "so_type").agg(F.count(F.lit(1)).alias("n")), f"SELECT brand, so_type, count(*) AS n FROM ({_ENRICHED}) e GROUP BY 1, 2", *_EV)
add("business_type_rule", lambda s, d: enriched(s, d).groupBy("branch", "business_type").agg(F.count(F.lit(1)).alias("n")), f"SELECT branch, business_type, count(*) AS n FROM ({_ENRICHED}) e GROUP BY 1, 2", *_EV)
add("anti_unmatched_party", lambda s, d: M.unmatched_parties(load(s, d), load(s, d, "fx_party_grouping_master")), f"SELECT DISTINCT {_party('to_party_name')} AS party_key FROM fx_sales WHERE {_party('to_party_name')} NOT IN (SELECT {_party('to_party_name')} FROM fx_party_grouping_master)", "fx_sales", "fx_party_grouping_master")
add("anti_new_party", lambda s, d: M.new_parties(load(s, d), load(s, d, "fx_party_grouping_master")).select(F.lower("to_party_name").alias("k")), "SELECT DISTINCT lower(trim(to_party_name)) AS k FROM fx_sales WHERE lower(trim(to_party_name)) NOT IN (SELECT lower(trim(to_party_name)) FROM fx_party_grouping_master)", "fx_sales", "fx_party_grouping_master")
add("delete_range_preview", lambda s, d: M.delete_range_preview(load(s, d), "1997-01-01", "1998-06-30"), "SELECT count(*) AS n FROM fx_sales WHERE bill_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")


add("audit_diff", lambda s, d: M.audit_diff(load(s, d, "fx_party_grouping_master"), load(s, d, "fx_party_grouping_master").withColumn("party_grouped", F.when(F.col("id") % 2 == 0, "X").otherwise(F.col("party_grouped"))), "id"), "SELECT id, 'party_grouped' AS column_name, party_grouped AS before, 'X' AS after FROM fx_party_grouping_master WHERE id % 2 = 0 AND coalesce(party_grouped,'') <> 'X'", "fx_party_grouping_master")
add("backfill_so_type", lambda s, d: M.backfill_so_type(load(s, d), load(s, d, _SO)).groupBy("so_type").agg(F.count(F.lit(1)).alias("n")), "WITH l AS (SELECT trim(regexp_replace(lower(party_name), '[^a-z0-9 \\-]', '', 'g')) AS k, arg_max(type_of_order, (so_order_date, id)) AS t FROM fx_so_master GROUP BY 1) SELECT CASE WHEN sl_qty <= 0 THEN 'RETURN' ELSE t END AS so_type, count(*) AS n FROM fx_sales LEFT JOIN l ON k = trim(regexp_replace(lower(to_party_name), '[^a-z0-9 \\-]', '', 'g')) GROUP BY 1", "fx_sales", _SO)
add("lookup_conflicts", lambda s, d: M.lookup_conflicts(load(s, d, _SO)), "SELECT trim(regexp_replace(lower(party_name), '[^a-z0-9 \\-]', '', 'g')) AS party_key, count(DISTINCT type_of_order) AS types FROM fx_so_master GROUP BY 1 HAVING count(DISTINCT type_of_order) > 1", _SO)
add("match_stats", lambda s, d: M.match_stats(load(s, d), load(s, d, _SO)), "WITH k AS (SELECT DISTINCT lower(replace(party_name,'#','')) AS k FROM fx_so_master), x AS (SELECT p AS party_key, k, count(*) AS n FROM (SELECT trim(regexp_replace(lower(to_party_name), '[^a-z0-9 \\-]', '', 'g')) AS p FROM fx_sales) s LEFT JOIN k ON k = p GROUP BY 1, 2) SELECT 'processed' AS kind, '' AS party_key, CAST(sum(n) AS BIGINT) AS n FROM x UNION ALL SELECT CASE WHEN k IS NULL THEN 'unmatched' ELSE 'matched' END, '', CAST(sum(n) AS BIGINT) FROM x GROUP BY 1 UNION ALL (SELECT 'top unmatched', party_key, n FROM x WHERE k IS NULL ORDER BY n DESC, party_key LIMIT 20)", "fx_sales", _SO)
add("win_total_count", lambda s, d: H.so_preview(load(s, d, _SO), "VERCELLI", "1996-97").select("id", "party_name", "total"), "SELECT id, party_name, count(*) OVER () AS total FROM fx_so_master WHERE brand = 'VERCELLI' AND fy = '1996-97' ORDER BY party_name, id LIMIT 20", _SO)
