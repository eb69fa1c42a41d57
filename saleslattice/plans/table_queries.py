"""Registered queries of grids, ledgers, edits, pivot bodies and further lookups, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import filters as W
from ..operators import grid as G
from ..operators import history as H
from ..operators import lookups as L
from ..operators import maintain as M
from ..operators import rollups as R
from ..sources import facts
from ..sources import scratch
from ..sources.fixtures import load
from ..streaming import ingest
from . import body as B
from . import pivot as P
from .queries import _ENRICHED, _EV, _GOODS, AGG, QUERIES, SQL, MONTH_AXIS, MONTH_NO, NOT_TOTAL, _derived, _fy, _party, _strip, _total, add

__all__ = ["QUERIES", "SQL"]

_SO, _GROUPS, _AGENTS, _PARTIES, _TYPES, _REGIONS = "fx_so_master", "fx_party_grouping_master", "fx_agent_name_master", "fx_party_master_app", "fx_customer_type_master", "fx_region_master"


def _count():
    return F.count(F.lit(1)).alias("n")


def _flat3(df: DataFrame, t) -> DataFrame:
    return df.select(t.alias("t")).groupBy(F.col("t.fy").alias("fy"), F.col("t.month").alias("month"), F.col("t.mmm").alias("mmm")).agg(_count())


def _triple(y: str, m: str) -> str:
    s = f"({y} - CASE WHEN {m} < 4 THEN 1 ELSE 0 END)"
    name = f"(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[{m}]"
    return f"{{'fy': concat({s}, '-', lpad(CAST(({s} + 1) % 100 AS VARCHAR), 2, '0')), 'month': concat({name}, '-', right(CAST({y} AS VARCHAR), 2)), 'mmm': upper({name})}}"


_T3 = "SELECT t.fy AS fy, t.month AS month, t.mmm AS mmm, count(*) AS n FROM (SELECT CASE {} END AS t FROM ({}) s) u GROUP BY 1, 2, 3"
_MONTH_Y = "(2000 + CAST(right(month, 2) AS INT))"
add("temporal_triple", lambda s, d: _flat3(load(s, d), X.temporal_triple()), _T3.format(f"WHEN year(bill_date) >= 2000 THEN {_triple('year(bill_date)', 'month(bill_date)')} WHEN regexp_matches(month, '^[A-Za-z]{{3}}-[0-9]{{2}}$') THEN {_triple(_MONTH_Y, MONTH_NO)}", "SELECT * FROM fx_sales"))
_NUM = "SELECT * REPLACE (CAST(month(sale_order_date) AS VARCHAR) AS month, CASE WHEN sl_qty > 5 THEN '1997-98' END AS fy) FROM fx_sales"
_D = "coalesce(bill_date, sale_order_date)"
add("temporal_fallback_numeric", lambda s, d: _flat3(load(s, d).withColumns({"month": F.month("sale_order_date").cast("string"), "fy": F.when(F.col("sl_qty") > 5, "1997-98")}), X.temporal_fallback_numeric()), _T3.format(f"WHEN year({_D}) >= 2000 THEN {_triple(f'year({_D})', f'month({_D})')} WHEN fy IS NOT NULL THEN {_triple('(1997 + CASE WHEN CAST(month AS INT) < 4 THEN 1 ELSE 0 END)', 'CAST(month AS INT)')}", _NUM))
add("fill_temporal", lambda s, d: load(s, d).groupBy(X.fill_temporal("fy").alias("fy"), X.fill_temporal("month").alias("month"), X.fill_temporal("mmm").alias("mmm")).agg(_count()), f"SELECT coalesce(nullif(trim(fy),''), {_fy('bill_date')}) AS fy, {MONTH_AXIS} AS month, coalesce(nullif(trim(mmm),''), upper(strftime(bill_date, '%b'))) AS mmm, count(*) AS n FROM fx_sales GROUP BY 1, 2, 3")
_derived("parse_month_year", lambda: X.month_year(F.col("month"))["y"], "CASE WHEN regexp_matches(month, '^[A-Za-z]{3}-[0-9]{2}$') THEN 2000 + CAST(right(month, 2) AS INT) END", "month")
_derived("parse_month_only", lambda: X.month_only(F.date_format("bill_date", "MMMM")), "month(bill_date)")
_derived("parse_fy_start", lambda: X.fy_start(F.col("fy")), "CAST(left(fy, 4) AS INT)", "fy")
_derived("fy_to_range", lambda: X.fy_to_range(X.fy_of_date(F.col("bill_date")))["lo"], "CASE WHEN year(bill_date) - CASE WHEN month(bill_date) < 4 THEN 1 ELSE 0 END >= 2000 THEN make_date(year(bill_date) - CASE WHEN month(bill_date) < 4 THEN 1 ELSE 0 END, 4, 1) END")
_derived("join_key", lambda: X.join_key(F.col("state"), F.col("brand")), "concat_ws('||', coalesce(state, '(blank)'), coalesce(brand, '(blank)'))", "state")
_derived("split_key", lambda: X.split_key(X.join_key(F.col("state"), F.col("brand")), 3)[1], "coalesce(brand, '(blank)')", "brand")
_derived("json_payload", lambda: X.json_payload("bill_no", "item_no"), "concat('{\"bill_no\":\"', bill_no, '\",\"item_no\":\"', item_no, '\"}')", "bill_no")
_derived("party_filter_values", lambda: F.array_join(X.party_filter_values(F.col("to_party_name")), "|"), f"CASE WHEN trim({_strip('to_party_name')}) <> trim(to_party_name) THEN concat(trim(to_party_name), '|', trim({_strip('to_party_name')})) ELSE trim(to_party_name) END", "to_party_name")
_derived("clean_business_type", lambda: X.clean_type(F.col("business_type")), "nullif(trim(business_type),'')", "business_type")
add("clean_order_type", lambda s, d: load(s, d, _SO).groupBy(X.clean_type(F.concat(F.lit("​ "), "type_of_order", F.lit(" "))).alias("value")).agg(_count()), f"SELECT type_of_order AS value, count(*) AS n FROM {_SO} GROUP BY 1", _SO)
add("party_exact_key", lambda s, d: load(s, d).select("to_party_name").distinct().select("to_party_name", X.party_exact_key(F.col("to_party_name")).alias("k")), "SELECT DISTINCT to_party_name, upper(trim(to_party_name)) AS k FROM fx_sales")
_derived("derive_group_name", lambda: X.derive_group_name(F.concat("agent_name", F.lit(" - "), F.coalesce("state", F.lit("")))), "CASE WHEN coalesce(state, '') = '' THEN concat(agent_name, ' -') ELSE agent_name END", "agent_name")

# Filters and searches.
add("f_valid_iso_date", lambda s, d: load(s, d).agg(F.count_if(X.valid_iso_date(F.concat(F.date_format("sale_order_date", "yyyy-MM-"), F.lit("31")))).alias("n")), "SELECT count(*) FILTER (month(sale_order_date) IN (1,3,5,7,8,10,12)) AS n FROM fx_sales")
_FOUND = "SELECT to_party_name AS p FROM fx_party_grouping_master WHERE contains(lower(party_grouped), 'group 7') UNION SELECT trim(regexp_replace(regexp_replace(trim(to_party_name), '^m/s\\.?\\s*', '', 'i'), '^ms\\.?\\s*', '', 'i')) FROM fx_party_grouping_master WHERE contains(lower(party_grouped), 'group 7')"
_FX2 = ("fx_sales", _GROUPS)
add("distinct_union_search", lambda s, d: W.search_parties(load(s, d, _GROUPS), "group 7"), _FOUND, _GROUPS)
add("semi_search_party", lambda s, d: _total(load(s, d).join(W.search_parties(load(s, d, _GROUPS), "group 7"), F.col("to_party_name") == F.col("p"), "left_semi"), F.lit(True)), f"SELECT {AGG} FROM fx_sales WHERE to_party_name IN ({_FOUND})", *_FX2)
add("f_search", lambda s, d: _total(W.search(load(s, d), load(s, d, _GROUPS), "group 7", "NATION_7"), F.lit(True)), f"SELECT {AGG} FROM fx_sales WHERE state = 'NATION_7' AND (bill_no ILIKE '%group 7%' OR coalesce(party_grouped ILIKE '%group 7%', false) OR to_party_name IN ({_FOUND}))", *_FX2)
_GRID = "SELECT id, bill_no, branch FROM (SELECT * FROM fx_sales WHERE state = 'NATION_7' AND (bill_no ILIKE '%B-1%' OR coalesce(party_grouped ILIKE '%B-1%', false)) ORDER BY id DESC LIMIT 50 OFFSET 50) x WHERE " + NOT_TOTAL
add("grid_page", lambda s, d: W.grid_page(load(s, d), load(s, d, _GROUPS), "B-1", "NATION_7", page=2, limit=50).select("id", "bill_no", "branch"), _GRID)

# Lookups and joins.
add("lookup_so_master", lambda s, d: L.lookup_so_master(load(s, d).withColumn("fy", F.concat(F.year("sale_order_date"), F.lit("-"), F.right((F.year("sale_order_date") + 1).cast("string"), F.lit(2)))), load(s, d, _SO)).groupBy("so_exact").agg(_count()), f"WITH m AS (SELECT upper(trim(party_name)) AS p, upper(trim(brand)) AS b, trim(fy) AS f, arg_max(type_of_order, (so_order_date, id)) AS t FROM fx_so_master GROUP BY 1, 2, 3), x AS (SELECT upper(trim(to_party_name)) AS p, CASE upper(trim(brand)) WHEN 'D&J' THEN 'DON AND JULIO' WHEN 'IC' THEN 'ITALIAN CHANNEL' WHEN 'RF' THEN 'RISHAB FABRICS' ELSE upper(trim(brand)) END AS b, concat(year(sale_order_date), '-', right(CAST(year(sale_order_date) + 1 AS VARCHAR), 2)) AS f FROM fx_sales) SELECT m.t AS so_exact, count(*) AS n FROM x LEFT JOIN m ON x.p = m.p AND x.b = m.b AND x.f = m.f GROUP BY 1", "fx_sales", _SO)
add("lookup_party_group_report", lambda s, d: L.lookup_party_group_report(load(s, d), load(s, d, _GROUPS)).groupBy("party_grouped", "party_name_for_count").agg(_count()), f"SELECT CASE WHEN m.id IS NULL THEN s.party_grouped ELSE coalesce(m.party_grouped, s.to_party_name) END AS party_grouped, CASE WHEN m.id IS NULL THEN s.party_name_for_count ELSE m.party_name_for_count END AS party_name_for_count, count(*) AS n FROM fx_sales s LEFT JOIN {_GROUPS} m ON {_party(_strip('s.to_party_name'))} = {_party('m.to_party_name')} GROUP BY 1, 2", *_FX2)
add("join_ref_region", lambda s, d: L.seed_regions(s.read.parquet(f"{d}/nation.parquet").selectExpr("n_name AS state", "n_regionkey AS region_id"), s.read.parquet(f"{d}/region.parquet").selectExpr("r_regionkey AS id", "r_name AS region"), load(s, d, _REGIONS)), "SELECT n_name AS state, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", _REGIONS)
add("join_edit_history", lambda s, d: _history(s, d), "SELECT id, table_name, row_id, CASE WHEN id % 2 = 0 THEN row_id END AS before, CASE WHEN id % 3 = 0 THEN status END AS after FROM fx_event WHERE table_name = 'party' ORDER BY ts DESC, id DESC LIMIT 100", "fx_event")


def _history(s, d) -> DataFrame:
    e = load(s, d, "fx_event")
    before, after = e.where("id % 2 = 0").selectExpr("id AS event_id", "row_id AS payload"), e.where("id % 3 = 0").selectExpr("id AS event_id", "status AS payload")
    return H.edit_history(e, before, after, "party").select("id", "table_name", "row_id", "before", "after")


add("join_row_snapshot", lambda s, d: H.row_snapshot(load(s, d, "fx_event").select("table_name", "row_id", "id"), {"party": load(s, d, _GROUPS), "type": load(s, d, _TYPES)}).groupBy("table_name", F.get_json_object("snapshot", "$.type").alias("type"), F.get_json_object("snapshot", "$.party_grouped").alias("grouped")).agg(_count()), f"SELECT e.table_name, CASE WHEN e.table_name = 'type' THEN t.type END AS type, CASE WHEN e.table_name = 'party' THEN g.party_grouped END AS grouped, count(*) AS n FROM fx_event e LEFT JOIN {_GROUPS} g ON CAST(g.id AS VARCHAR) = e.row_id LEFT JOIN {_TYPES} t ON CAST(t.id AS VARCHAR) = e.row_id GROUP BY 1, 2, 3", "fx_event", _GROUPS, _TYPES)

# Aggregates, windows, top-k.
add("filter_options", lambda s, d: P.distinct_values_batch(load(s, d), ["state", "party_grouped", "business_type"], 2000), " UNION ".join(f"SELECT '{c}' AS field, trim({c}) AS value, CAST(NULL AS VARCHAR) AS error FROM fx_sales WHERE trim({c}) <> ''" for c in ("state", "party_grouped", "business_type")))
_AGENT = f"SELECT s.*, coalesce(m.combined_name, trim(s.agent_name)) AS agent_name_final FROM fx_sales s LEFT JOIN {_AGENTS} m ON lower(replace(s.agent_name,'.','')) = lower(m.agent_name)"
for _n in ("agent_final_branch", "party_agent_branch"):
    _k = ", ".join(R.ROLLUPS[_n])
    add(f"rollup_{_n}", lambda s, d, n=_n: R.rollup(L.lookup_agent(load(s, d), load(s, d, _AGENTS)), n), f"SELECT {_k}, sum(net_amount) AS total_net, sum(amount_before_tax) AS total_before_tax, sum(sl_qty) AS total_qty, count(*) AS fact_row_count FROM ({_AGENT}) x WHERE {NOT_TOTAL} GROUP BY {_k}", "fx_sales", _AGENTS)
_FOLD = P.config(["agent_name_final"], ["mmm"], [("net_amount", "sum"), ("id", "count")], [{"field": "state", "operator": "in", "values": ["nation_7", "Nation_11"]}])


def _folded(s, d) -> DataFrame:
    shown = load(s, d).withColumns({"agent_name_final": F.when(F.col("sl_qty") > 40, "FINAL"), "agent_names_correction": F.lit(None).cast("string")})
    got = P.pivot_casefold(shown, load(s, d, _AGENTS), _FOLD)
    return got.withColumns({"row_labels": F.array_join("row_labels", "||"), "col_labels": F.array_join("col_labels", "||")})


add("pivot_casefold", _folded, f"""WITH b AS (SELECT coalesce(nullif(trim(CASE WHEN sl_qty > 40 THEN 'FINAL' ELSE agent_name_final END),''),'(blank)') AS r1, coalesce(nullif(trim(mmm),''), CASE WHEN year(bill_date) >= 2000 THEN upper(strftime(bill_date, '%b')) WHEN regexp_matches(month, '^[A-Za-z]{{3}}-[0-9]{{2}}$') THEN upper(left(month, 3)) END, '(blank)') AS c1, net_amount
  FROM ({_AGENT}) x WHERE {NOT_TOTAL} AND lower(trim(coalesce(state,''))) IN ('nation_7', 'nation_11')),
g AS (SELECT r1, c1, coalesce(sum(net_amount),0) AS sum_net_amount, count(*) AS count_id FROM b GROUP BY GROUPING SETS ((r1, c1), (r1), (c1), ()))
SELECT CASE WHEN r1 IS NOT NULL AND c1 IS NOT NULL THEN 'cell' WHEN r1 IS NOT NULL THEN 'row_total' WHEN c1 IS NOT NULL THEN 'column_total' ELSE 'grand_total' END AS kind, CAST((r1 IS NOT NULL)::INT AS INT) AS depth, coalesce(r1,'') AS row_labels, coalesce(c1,'') AS col_labels, sum_net_amount, count_id FROM g""", "fx_sales", _AGENTS)
add("rollup_all_dims", lambda s, d: R.rollup(load(s, d), "all_dims"), "SELECT * EXCLUDE (id), sum(sl_qty) AS sum_sl_qty, sum(gross_amount) AS sum_gross_amount, sum(amount_before_tax) AS sum_amount_before_tax, sum(net_amount) AS sum_net_amount, count(*) AS fact_row_count FROM fx_sales GROUP BY ALL")
add("approx_count", lambda s, d: facts.approx_count(s, _stored(s, d)), "SELECT count(*) AS n FROM fx_sales")
add("win_dedupe_last", lambda s, d: G.keep(load(s, d, _SO).select("party_name", "brand", "fy", "id", "type_of_order"), ["party_name", "brand", "fy"], "id"), "SELECT party_name, brand, fy, max(id) AS id, arg_max(type_of_order, id) AS type_of_order FROM fx_so_master GROUP BY 1, 2, 3", _SO)
add("win_dedupe_first", lambda s, d: G.keep(load(s, d, _SO).select("party_name", "id", "brand"), ["party_name"], "id", last=False), "SELECT party_name, min(id) AS id, arg_min(brand, id) AS brand FROM fx_so_master GROUP BY 1", _SO)
add("win_latest_by_date", lambda s, d: G.keep(load(s, d, _SO).select("party_name", F.struct("so_order_date", "id").alias("at"), "type_of_order"), ["party_name"], "at").select("party_name", "type_of_order"), "SELECT party_name, arg_max(type_of_order, (so_order_date, id)) AS type_of_order FROM fx_so_master GROUP BY 1", _SO)
_GROWS = "SELECT sheet, rn, len(cells) AS n FROM fx_grid"
add("win_drop_footer", lambda s, d: G.drop_footer(load(s, d, "fx_grid")).select("sheet", "rn", F.size("cells").cast("long").alias("n")), f"{_GROWS} WHERE (sheet, rn) NOT IN (SELECT (sheet, max(rn)) FROM fx_grid GROUP BY sheet)", "fx_grid")
add("top_history", lambda s, d: H.top(load(s, d, "fx_event"), "ended", 30).select("id", "ended"), "SELECT id, ended FROM fx_event ORDER BY ended DESC NULLS LAST, id DESC LIMIT 30", "fx_event")
add("master_preview", lambda s, d: H.master_preview(load(s, d, _SO), "urgent").select("id", "party_name"), f"SELECT id, party_name FROM {_SO} WHERE contains(lower(concat_ws('|', party_name, brand, fy, type_of_order)), 'urgent') ORDER BY id DESC LIMIT 200", _SO)
add("sample_unmatched", lambda s, d: M.unmatched_parties(load(s, d), load(s, d, _GROUPS)).orderBy("party_key").limit(20), f"SELECT DISTINCT {_party('to_party_name')} AS party_key FROM fx_sales WHERE {_party('to_party_name')} NOT IN (SELECT {_party('to_party_name')} FROM {_GROUPS}) ORDER BY 1 LIMIT 20", *_FX2)
add("cap_groups", lambda s, d: B.cap_groups(load(s, d).groupBy("to_party_name", "brand").agg(_count()), ["to_party_name", "brand"], 1000).select("to_party_name", "brand", "n", F.col("dropped").cast("long").alias("dropped")), "WITH g AS (SELECT to_party_name, brand, count(*) AS n FROM fx_sales GROUP BY 1, 2) SELECT to_party_name, brand, n, (SELECT greatest(count(*) - 1000, 0) FROM g) AS dropped FROM g ORDER BY to_party_name, brand LIMIT 1000")

# Pivot bodies. Labels sort in natural order; those of the tables hold one number at most, at their end.


def _natural(c: str) -> str:
    return f"{c} = '(blank)', concat(regexp_extract(lower({c}), '^[^0-9]*'), lpad(regexp_extract({c}, '[0-9]+'), 20, '0'))"


_BODY = P.config(["state", "brand"], [], [("net_amount", "sum")], subtotals=["state"])
_LINES = f"SELECT CASE WHEN r2 IS NULL THEN 'subtotal' ELSE 'row' END AS type, CASE WHEN r2 IS NULL THEN 1 ELSE 2 END AS depth, concat_ws('||', r1, r2) AS labels, coalesce(sum(net_amount), 0) AS sum_net_amount{{}} FROM (SELECT coalesce(nullif(trim(state),''),'(blank)') AS r1, coalesce(nullif(trim(brand),''),'(blank)') AS r2, net_amount FROM fx_sales WHERE {NOT_TOTAL}) b GROUP BY GROUPING SETS ((r1, r2), (r1))"


def _labels():
    return F.array_join("labels", "||").alias("labels")


add("body_lines", lambda s, d: B.body_lines(load(s, d), _BODY).select("type", "depth", _labels(), "sum_net_amount"), _LINES.format(""))
add("body_window", lambda s, d: B.body_window(load(s, d), _BODY, 20, 30).select("type", "depth", _labels(), "sum_net_amount", "total_lines"), _LINES.format(", count(*) OVER () AS total_lines") + f" ORDER BY {_natural('r1')}, r2 IS NULL, {_natural('r2')} LIMIT 30 OFFSET 20")
_XT = P.config(["state"], ["brand"], [("net_amount", "sum")])
_HEADS = ["D&J", "IC", "RF", "VERCELLI"]
_WIDE = ", ".join(f"CASE WHEN count(*) FILTER (b = '{h}') > 0 THEN coalesce(sum(net_amount) FILTER (b = '{h}'), 0) END AS \"{h}\"" for h in _HEADS)
_XSQL = f"SELECT CASE WHEN r1 IS NULL THEN 'total' ELSE 'body' END AS kind, coalesce(r1, 'Grand Total') AS row_key, {_WIDE}, coalesce(sum(net_amount), 0) AS \"Total\" FROM (SELECT coalesce(nullif(trim(state),''),'(blank)') AS r1, trim(brand) AS b, net_amount FROM fx_sales WHERE {NOT_TOTAL}) x GROUP BY GROUPING SETS ((r1), ())"
add("pivot_export_grid", lambda s, d: B.export_grid(load(s, d), _XT, _HEADS), _XSQL)
_CT = P.config(["state"], ["brand", "goods"], [("net_amount", "sum"), ("id", "count")])
_CH = [("IC", "Fresh"), ("IC", "(blank)"), ("RF", "MID"), ("Rare Wool", "ACC")]


def _in(c: str) -> str:
    """Indian grouping of a whole number of up to 12 digits."""
    r = f"CAST(round({c}) AS BIGINT)"
    t = f"CAST(abs({r}) AS VARCHAR)"
    head = f"left({t}, -3)"
    pairs = f"array_to_string(list_transform(range(CAST(ceil(length({head}) / 2.0) AS BIGINT)), lambda i: substr(concat(CASE WHEN length({head}) % 2 = 1 THEN ' ' ELSE '' END, {head}), 2 * i + 1, 2)), ',')"
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN abs({r}) < 1000 THEN CAST({r} AS VARCHAR) ELSE concat(CASE WHEN {r} < 0 THEN '-' ELSE '' END, ltrim({pairs}), ',', right({t}, 3)) END"


def _cell(c: str) -> str:
    return f"CASE WHEN contains({c}, ',') THEN concat('\"', {c}, '\"') ELSE coalesce({c}, '') END"


_SHOWN = ["sum(net_amount)", "count(*)"]
_CELLS = [_cell(_in(f"CASE WHEN count(*) FILTER (b = '{b}' AND g = '{g}') > 0 THEN coalesce({v} FILTER (b = '{b}' AND g = '{g}'), 0) END")) for b, g in _CH for v in _SHOWN] + [_cell(_in(f"coalesce({v}, 0)")) for v in _SHOWN]
_CSQL = f"""SELECT * FROM (VALUES ('ROWS,IC,IC,IC,IC,RF,RF,RARE WOOL,RARE WOOL,,'), ('STATE,FRESH,FRESH,(BLANK),(BLANK),MID,MID,ACC,ACC,GRAND TOTAL,GRAND TOTAL'), (',{",".join(["SUM net_amount,COUNT id"] * 5)}')) v(line)
UNION ALL SELECT concat_ws(',', coalesce(r1, 'GRAND TOTAL'), {", ".join(_CELLS)}) FROM (SELECT coalesce(nullif(trim(state),''),'(blank)') AS r1, coalesce(nullif(trim(brand),''),'(blank)') AS b, coalesce({_GOODS},'(blank)') AS g, net_amount FROM fx_sales WHERE {NOT_TOTAL}) x GROUP BY GROUPING SETS ((r1), ())"""


def _csv(s, d) -> DataFrame:
    """The export, written as text and read back; reading drops the byte order mark."""
    lines = B.export_pivot_csv(load(s, d).withColumn("goods", X.goods_type(F.col("sale_order_no"))), _CT, _CH)
    facts.sink_lines(lines, at := scratch.folder(s))
    return s.read.text(at).withColumnRenamed("value", "line")


add("export_pivot_csv", _csv, _CSQL)
add("cap_cells", lambda s, d: B.cap_cells(P.pivot(load(s, d), _XT).where("kind = 'cell'"), 1, 100).select(F.array_join("row_labels", "||").alias("r"), F.array_join("col_labels", "||").alias("c"), "sum_net_amount"), f"WITH b AS (SELECT coalesce(nullif(trim(state),''),'(blank)') AS r, coalesce(nullif(trim(brand),''),'(blank)') AS c, net_amount FROM fx_sales WHERE {NOT_TOTAL}), k AS (SELECT c, row_number() OVER (ORDER BY {_natural('c')}) AS i FROM (SELECT DISTINCT c FROM b) y) SELECT r, b.c AS c, coalesce(sum(net_amount), 0) AS sum_net_amount FROM b JOIN k ON b.c = k.c WHERE i * (SELECT count(DISTINCT r) FROM b) <= 100 GROUP BY 1, 2")

# Grids.
_GA = ("fx_grid", "fx_alias")


def _heads(s, d) -> DataFrame:
    return G.header_cells(load(s, d, "fx_grid"))


_HROW = "SELECT DISTINCT sheet, rn FROM fx_grid WHERE rn <= 2"
add("resolve_header", lambda s, d: G.resolve_header(_heads(s, d), load(s, d, "fx_alias")).select("sheet", "pos", "canonical"), f"SELECT sheet, unnest([0, 2, 4, 5, 6, 7]) AS pos, unnest(['PARTY NAME','TYPE OF ORDER','SL QTY','SL QTY','RATE/UNIT','RATE/UNIT']) AS canonical FROM ({_HROW}) h WHERE rn = 2", *_GA)
add("header_index", lambda s, d: G.header_index(_heads(s, d), load(s, d, "fx_alias")).select("sheet", "pos", "canonical"), f"SELECT sheet, unnest([0, 2, 5, 7]) AS pos, unnest(['PARTY NAME','TYPE OF ORDER','SL QTY','RATE/UNIT']) AS canonical FROM ({_HROW}) h WHERE rn = 2", *_GA)
_DATA = "(SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY rn DESC) AS back FROM fx_grid) g WHERE rn > 2 AND back > 1"
add("type_row", lambda s, d: _data(s, d).select("sheet", "rn", G.type_row("PARTY NAME").alias("party"), G.type_row("SL QTY").alias("qty"), G.type_row("RATE/UNIT").alias("rate")), f"SELECT sheet, rn, nullif(trim(cells[2]), '') AS party, CAST(cells[7] AS DOUBLE) AS qty, CAST(NULL AS DOUBLE) AS rate FROM {_DATA}", *_GA)
add("import_so_master", lambda s, d: G.import_so_master(load(s, d, "fx_grid"), load(s, d, "fx_alias"), "IC", "1997-98"), f"SELECT upper(trim(cells[2])) AS party_name, 'IC' AS brand, '1997-98' AS fy, upper(arg_max(cells[4], (sheet, rn))) AS type_of_order FROM {_DATA} AND trim(cells[2]) <> '' GROUP BY 1", *_GA)


def _data(s, d) -> DataFrame:
    return G.data_rows(load(s, d, "fx_grid"), G.header_index(_heads(s, d), load(s, d, "fx_alias")))


add("scan_master", lambda s, d: facts.scan_master(load(s, d, _PARTIES).withColumnsRenamed({"account_name": "ACCOUNT_NAME"}), {"party_name": ["Party Name", "ACCOUNT_NAME"], "district": ["LEVEL1", "district"]}), f"SELECT trim(account_name) AS party_name, trim(district) AS district FROM {_PARTIES}", _PARTIES)

# Maintenance.
add("job_ledger", lambda s, d: M.job_state(load(s, d, "fx_event").withColumns({"id": F.col("job"), "ts": F.struct("ts", "id")})), "SELECT job AS id, arg_max(status, (ts, id)) AS status, arg_max(processed_rows, (ts, id)) AS processed_rows, arg_max(failed_rows, (ts, id)) AS failed_rows, min(queued_at) AS queued_at, min(started_at) AS started_at FROM fx_event GROUP BY 1", "fx_event")
add("upload_history", lambda s, d: H.top(load(s, d, "fx_event").where("table_name = 'party'"), "ts", 20).select("id", "ts", "status"), "SELECT id, ts, status FROM fx_event WHERE table_name = 'party' ORDER BY ts DESC NULLS LAST, id DESC LIMIT 20", "fx_event")
add("union_so_masters", lambda s, d: M.union_masters(*(load(s, d, _SO).where(F.col("id") % 4 == i) for i in range(4)), None).groupBy("brand").agg(_count()), f"SELECT brand, count(*) AS n FROM {_SO} GROUP BY 1", _SO)
_NEW = f"SELECT min(trim(to_party_name)) AS p, count(DISTINCT lower(trim(to_party_name))) AS n FROM fx_sales WHERE lower(trim(to_party_name)) NOT IN (SELECT lower(trim(to_party_name)) FROM {_GROUPS})"
add("seed_party_grouping", lambda s, d: M.new_parties(load(s, d), load(s, d, _GROUPS)).agg(F.min("to_party_name").alias("p"), _count()), _NEW, *_FX2)
add("union_new_parties", lambda s, d: M.union_masters(load(s, d, _GROUPS), M.new_parties(load(s, d), load(s, d, _GROUPS))).agg(F.count_if(F.col("id").isNull()).alias("fresh"), F.count("id").alias("old")), f"SELECT (SELECT n FROM ({_NEW}) x) AS fresh, (SELECT count(*) FROM {_GROUPS}) AS old", *_FX2)
add("edit_so_master", lambda s, d: M.edit_so_master(load(s, d, _SO), load(s, d), load(s, d, _SO).where("id % 40 = 0").select("party_name", "brand").distinct().withColumn("type_of_order", F.lit("NEW")))[2].groupBy("column_name", "before", "after").agg(_count()), f"SELECT 'type_of_order' AS column_name, type_of_order AS before, 'NEW' AS after, count(*) AS n FROM {_SO} WHERE (party_name, brand) IN (SELECT (party_name, brand) FROM {_SO} WHERE id % 40 = 0) GROUP BY 2", _SO)
add("edit_siblings", lambda s, d: M.edit_siblings(load(s, d, _SO), load(s, d, _SO).where("id % 40 = 0").select("party_name", "brand").distinct().withColumn("type_of_order", F.lit("NEW"))).groupBy("type_of_order").agg(_count()), f"SELECT CASE WHEN (party_name, brand) IN (SELECT (party_name, brand) FROM {_SO} WHERE id % 40 = 0) THEN 'NEW' ELSE type_of_order END AS type_of_order, count(*) AS n FROM {_SO} GROUP BY 1", _SO)
add("backfill_district", lambda s, d: M.backfill_district(load(s, d).withColumn("district", F.when(F.col("sl_qty") > 40, "OLD")), load(s, d, _PARTIES)).groupBy("district").agg(_count()), f"SELECT CASE WHEN s.sl_qty > 40 THEN 'OLD' ELSE m.district END AS district, count(*) AS n FROM fx_sales s LEFT JOIN {_PARTIES} m ON {_party(_strip('s.to_party_name'))} = {_party(_strip('m.account_name'))} GROUP BY 1", "fx_sales", _PARTIES)
add("master_health", lambda s, d: H.health({"fact": (load(s, d), ["state", "district"]), "groups": (load(s, d, _GROUPS), ["party_grouped"])}), f"SELECT 'fact' AS table_name, 'state' AS column_name, count(*) AS n_rows, count(*) FILTER (coalesce(trim(state), '') = '') AS n_blank FROM fx_sales UNION ALL SELECT 'fact', 'district', count(*), count(*) FILTER (coalesce(trim(district), '') = '') FROM fx_sales UNION ALL SELECT 'groups', 'party_grouped', count(*), count(*) FILTER (party_grouped IS NULL) FROM {_GROUPS}", *_FX2)
add("enrich_display", lambda s, d: L.enrich_display(load(s, d), _all(s, d)).groupBy("business_type").agg(_count()), f"SELECT coalesce(m.type, 'RETAILER') AS business_type, count(*) AS n FROM fx_sales s LEFT JOIN {_TYPES} m ON {_party(_strip('s.to_party_name'))} = {_party('m.party_name')} WHERE {NOT_TOTAL} GROUP BY 1", "fx_sales", _TYPES)
add("enrich_agent_display", lambda s, d: L.display_agent(load(s, d).withColumns({"agent_name_final": F.when(F.col("sl_qty") > 20, "FINAL"), "agent_names_correction": F.when(F.col("sl_qty") > 40, "FIXED")}), load(s, d, _AGENTS)).groupBy("agent_name_final", "agent_names_correction").agg(_count()), f"SELECT CASE WHEN sl_qty > 20 THEN 'FINAL' ELSE agent_name_final END AS agent_name_final, CASE WHEN sl_qty > 40 THEN 'FIXED' WHEN sl_qty > 20 THEN 'FINAL' ELSE agent_name_final END AS agent_names_correction, count(*) AS n FROM ({_AGENT}) x GROUP BY 1, 2", "fx_sales", _AGENTS)


def _all(s, d) -> dict:
    return {"region": load(s, d, _REGIONS), "party": load(s, d, _PARTIES), "group": load(s, d, _GROUPS), "agent": load(s, d, _AGENTS), "type": load(s, d, _TYPES)}


# Sinks and streams: written to the cluster's shared folder and read back.
def _stored(s, d, fact: DataFrame | None = None) -> str:
    facts.sink_fact(load(s, d) if fact is None else fact, at := scratch.folder(s))
    return at


add("sink_fact", lambda s, d: s.read.parquet(_stored(s, d)).groupBy("fy_part", "norm_brand").agg(_count()), f"SELECT CASE WHEN bill_date >= DATE '2020-04-01' AND bill_date < DATE '2026-04-01' THEN {_fy('bill_date')} ELSE '__default__' END AS fy_part, upper(trim(coalesce(brand,''))) AS norm_brand, count(*) AS n FROM fx_sales GROUP BY 1, 2")
add("scan_fact", lambda s, d: _total(facts.scan_fact(s, _stored(s, d), "1997-01-15", "1998-06-30"), F.lit(True)), f"SELECT {AGG} FROM fx_sales WHERE bill_date BETWEEN DATE '1997-01-15' AND DATE '1998-06-30'")


def _written(s, d) -> tuple[str, str]:
    """Shards of the fact, with some rows without a number and some with an unreadable quantity, and their schema."""
    rows = load(s, d).withColumns({"rn": F.when(F.col("sl_qty") > 0, F.col("id")), "sl_qty": F.when((F.col("sl_qty") > 40) & (F.col("rate_unit") > 1500), "many").otherwise(F.col("sl_qty").cast("string"))})
    facts.sink_sharded_csv(rows, 4, at := scratch.folder(s))
    return at, ", ".join([f"rn {rows.schema['rn'].dataType.simpleString()}", *(f"{c} {t}" for c, t in load(s, d).dtypes)])


def _shards(s, d) -> DataFrame:
    return facts.read_shards(s, *_written(s, d))


def _imported(s, d) -> DataFrame:
    """Counts of all shards, and what is then in the fact and among the rejects."""
    counts = facts.load_sharded_csv(s, *_written(s, d), _all(s, d) | {"so": load(s, d, _SO)}, f"{(at := scratch.folder(s))}/fact", "job", f"{at}/rejects")
    seen = counts.agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))
    fact = s.read.parquet(f"{at}/fact").groupBy("so_type").agg(_count(), F.sum("net_amount").alias("total")).withColumn("kind", F.concat(F.lit("fact "), "so_type"))
    bad = s.read.parquet(f"{at}/rejects").agg(_count()).select(F.lit("rejects").alias("kind"), "n", F.lit(None).cast("decimal(25,4)").alias("total"))
    counted = seen.select(F.explode(F.array(F.struct(F.lit("processed").alias("kind"), F.col("processed").alias("n")), F.struct(F.lit("failed").alias("kind"), F.col("failed").alias("n")))).alias("x")).select("x.*", F.lit(None).cast("decimal(25,4)").alias("total"))
    return fact.select("kind", "n", "total").unionByName(bad).unionByName(counted)


add("sink_sharded_csv", lambda s, d: _shards(s, d).agg(F.countDistinct("shard").alias("shards"), F.max("rn").alias("last")), "SELECT 4 AS shards, max(id) AS last FROM fx_sales WHERE sl_qty > 0")
_BAD = "sl_qty > 40 AND rate_unit > 1500"
add("load_sharded_csv", _imported, f"SELECT concat('fact ', so_type) AS kind, count(*) AS n, sum(net_amount) AS total FROM ({_ENRICHED}) e WHERE sl_qty > 0 AND NOT ({_BAD}) GROUP BY 1 UNION ALL SELECT unnest(['processed', 'failed', 'rejects']), unnest([count(*), count(*) FILTER ({_BAD}), count(*) FILTER ({_BAD})]), NULL FROM fx_sales WHERE sl_qty > 0", *_EV)


def _rejects(s, d) -> DataFrame:
    bad = load(s, d).where("sl_qty < 0").select(F.col("id").alias("rn"), "bill_no", F.col("bill_date").cast("string").alias("bill_date"), "item_no", "to_party_name", F.lit("qty \"below\" 0").alias("error_message"))
    facts.sink_rejects(bad, "job", at := scratch.folder(s))
    return s.read.parquet(at)


add("sink_rejects", lambda s, d: _rejects(s, d).select("job_id", "row_number", "error_message", F.get_json_object("row_data", "$.bill_no").alias("bill_no")), "SELECT 'job' AS job_id, id AS row_number, 'qty \"below\" 0' AS error_message, bill_no FROM fx_sales WHERE sl_qty < 0")


def _groups_csv(s, d) -> DataFrame:
    named = load(s, d, _GROUPS).select(F.col("to_party_name").alias("To Party Name"), F.col("party_grouped").alias("Party Grouped"), F.lit(None).cast("string").alias("Party Name For Count"))
    named.write.option("header", True).csv(at := scratch.folder(s))
    return facts.scan_grouping_csv(s, at)


add("scan_grouping_csv", _groups_csv, f"SELECT to_party_name, coalesce(party_grouped, to_party_name) AS party_grouped, to_party_name AS party_name_for_count FROM {_GROUPS}", _GROUPS)
_derived("parse_date_cell", lambda: X.parse_date_cell(F.when(F.col("id") % 2 == 0, F.date_format("bill_date", "dd-MM-yyyy")).otherwise(F.datediff("bill_date", F.lit("1899-12-30").cast("date")).cast("string"))), "CASE WHEN year(bill_date) >= 2000 THEN bill_date END")
_MONTHS = f"SELECT state, CAST(date_trunc('month', bill_date) AS DATE) AS bill_month, sum(net_amount) AS total_net, sum(amount_before_tax) AS total_before_tax, sum(sl_qty) AS total_qty, count(*) AS fact_row_count FROM fx_sales WHERE {NOT_TOTAL} GROUP BY 1, 2"


def _ingested(s, d) -> DataFrame:
    load(s, d).write.parquet(f"{(at := scratch.folder(s))}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_stream(s, load(s, d).schema, f"{at}/in", f"{at}/out", f"{at}/log", _all(s, d) | {"so": load(s, d, _SO)}).awaitTermination()
    return s.read.parquet(f"{at}/out").groupBy("branch", "goods_type").agg(_count())


def _rolled(s, d) -> DataFrame:
    load(s, d).write.parquet(f"{(at := scratch.folder(s))}/in")
    for _ in range(2):
        ingest.rollup_stream(s, load(s, d).schema, f"{at}/in", f"{at}/out", f"{at}/log", "state_month").awaitTermination()
    return ingest.merged(s, f"{at}/out")


add("rollup_stream", _rolled, _MONTHS)
add("ingest_stream", _ingested, "SELECT CASE WHEN upper(trim(brand)) = 'RARE WOOL' AND upper(trim(branch)) = 'DON AND JULIO' THEN 'RARE WOOL' ELSE branch END AS branch, CASE WHEN nullif(trim(sale_order_no),'') IS NULL THEN NULL ELSE CASE regexp_extract(upper(regexp_replace(trim(sale_order_no), '^[''\"]+', '')), '^([A-Z]+)', 1) WHEN 'MID' THEN 'MID' WHEN 'MIX' THEN 'MIX' WHEN 'SRC' THEN 'SRC' WHEN 'ACS' THEN 'ACC' WHEN 'ACC' THEN 'ACC' ELSE 'Fresh' END END AS goods_type, count(*) AS n FROM fx_sales GROUP BY 1, 2")
