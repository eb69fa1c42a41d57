"""Registered queries of edit logs, stored partitions, keyed merges and rollup versions, with their oracles."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import edits as E
from ..operators import lookups as L
from ..operators import maintain as M
from ..operators import rollups as R
from ..sources import facts, scratch, stored
from ..sources.fixtures import load
from . import pivot as P
from .queries import _V, _VALUES, AGG, FY_AXIS, MONTH_AXIS, NOT_TOTAL, QUERIES, SQL, _total, add
from .table_queries import _AGENT, _AGENTS, _GROUPS, _SO, _TYPES, _count

__all__ = ["QUERIES", "SQL"]


def _norm(c: str) -> str:
    return f"upper(trim(coalesce({c}, '')))"


def _steps(log: str, old: str, new: str, values: str) -> str:
    """Updates k, seq, step and values of an edit log: of the old key, and of a new one."""
    return f"SELECT {_norm(old)} AS k, seq, 0 AS step, {values} FROM {log} UNION ALL SELECT {_norm(new)}, seq, 1, {values} FROM {log} WHERE trim(coalesce({new}, '')) <> trim(coalesce({old}, ''))"


def _last(steps: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, step DESC) AS n FROM ({steps}) s) r WHERE n = 1 AND k <> ''"


# Edit logs: the oracles apply the same edits in rounds, or take a key's last.
add("cascade_region", lambda s, d: E.cascade_region(load(s, d), load(s, d, "fx_region_log")).groupBy("state", "region").agg(_count()), f"SELECT s.state, CASE WHEN l.k IS NULL THEN s.region ELSE l.v END AS region, count(*) AS n FROM fx_sales s LEFT JOIN ({_last(_steps('fx_region_log', 'old_state', 'new_state', 'trim(new_region) AS v'))}) l ON {_norm('s.state')} = l.k GROUP BY 1, 2", "fx_sales", "fx_region_log")
_GROUP_LAST = _last(_steps("fx_party_log", "old_party", "new_party", "trim(new_group) AS g, trim(new_count) AS c"))
add("cascade_party_grouping", lambda s, d: E.cascade_party_grouping(load(s, d), load(s, d, "fx_party_log").select("seq", "old_party", "new_party", "new_group", "new_count")).groupBy("party_grouped", "party_name_for_count").agg(_count()), f"SELECT CASE WHEN l.k IS NULL THEN s.party_grouped ELSE l.g END AS party_grouped, CASE WHEN l.k IS NULL THEN s.party_name_for_count ELSE l.c END AS party_name_for_count, count(*) AS n FROM fx_sales s LEFT JOIN ({_GROUP_LAST}) l ON {_norm('s.to_party_name')} = l.k GROUP BY 1, 2", "fx_sales", "fx_party_log")


def _types_in_order() -> str:
    """The types of a party's rows after each of its updates (8 at most), one after the other."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq, step) AS i FROM ({_steps('fx_party_log', 'old_party', 'new_party', 'upper(trim(coalesce(old_type, chr(32)))) AS was, nullif(trim(new_type), chr(32)) AS v')}) s"
    ctes = [f"u AS (SELECT k, i, step = 1 OR was = '' AS free, was, CASE WHEN v = '' THEN NULL ELSE v END AS v FROM ({ranked}) r WHERE k <> '')", f"t0 AS (SELECT {_norm('to_party_name')} AS k, business_type AS t FROM fx_sales)"]
    for i in range(1, 9):
        ctes.append(f"t{i} AS (SELECT p.k, CASE WHEN u.k IS NOT NULL AND (u.free OR p.t IS NULL OR upper(trim(p.t)) = u.was) THEN u.v ELSE p.t END AS t FROM t{i - 1} p LEFT JOIN u ON u.k = p.k AND u.i = {i})")
    return f"WITH {', '.join(ctes)} SELECT t AS business_type, count(*) AS n FROM t8 GROUP BY 1"


add("cascade_customer_type", lambda s, d: E.cascade_customer_type(load(s, d), load(s, d, "fx_party_log").select("seq", "old_party", "new_party", "old_type", "new_type")).groupBy("business_type").agg(_count()), _types_in_order(), "fx_sales", "fx_party_log")


def _agents_in_order() -> str:
    """All agents' rows after the first, second and third edits of agents, which don't meet, and then after each edit without one."""
    out, rounds = [f"a0 AS (SELECT agent_name AS a, agent_names_correction AS c, agent_name_final AS f FROM (SELECT *, agent_name_final AS agent_names_correction FROM ({_AGENT}) z) y)"], 0

    def then(sql: str) -> None:
        nonlocal rounds
        rounds += 1
        out.append(f"a{rounds} AS ({sql.format(p=f'a{rounds - 1}')})")

    for k in (1, 2, 3):
        log = f"SELECT *, upper(trim(old_agent)) AS k FROM fx_agent_log WHERE seq < 900000000 AND seq % 10 = {k}"
        then(f"SELECT CASE WHEN l.k IS NOT NULL AND trim(l.old_agent) <> trim(l.new_agent) THEN trim(l.new_agent) ELSE p.a END AS a, p.c, p.f FROM {{p}} p LEFT JOIN ({log}) l ON upper(trim(p.a)) = l.k")
        given = f"SELECT k, v FROM (SELECT upper(trim(new_agent)) AS k, new_combined AS v, row_number() OVER (PARTITION BY upper(trim(new_agent)) ORDER BY seq DESC) AS n FROM fx_agent_log WHERE seq < 900000000 AND seq % 10 = {k}) r WHERE n = 1"
        then(f"SELECT p.a, CASE WHEN l.k IS NULL THEN p.c ELSE l.v END AS c, CASE WHEN l.k IS NULL THEN p.f ELSE l.v END AS f FROM {{p}} p LEFT JOIN ({given}) l ON upper(trim(p.a)) = l.k")
    for k in (0, 1, 2):
        one = f"(SELECT {{c}} FROM fx_agent_log WHERE seq = {900000000 + k})"
        hit = f"coalesce(upper(trim(p.c)) = upper({one.format(c='old_combined')}), false) OR coalesce(upper(trim(p.f)) = upper({one.format(c='old_combined')}), false)"
        then(f"SELECT p.a, CASE WHEN {hit} THEN {one.format(c='new_combined')} ELSE p.c END AS c, CASE WHEN {hit} THEN {one.format(c='new_combined')} ELSE p.f END AS f FROM {{p}} p")
    return f"WITH {', '.join(out)} SELECT a AS agent_name, c AS agent_names_correction, f AS agent_name_final, count(*) AS n FROM a{rounds} GROUP BY 1, 2, 3"


add("cascade_agent", lambda s, d: E.cascade_agent(L.lookup_agent(load(s, d), load(s, d, _AGENTS)), load(s, d, "fx_agent_log")).groupBy("agent_name", "agent_names_correction", "agent_name_final").agg(_count()), _agents_in_order(), "fx_sales", _AGENTS, "fx_agent_log")
_SO_STEPS = "SELECT upper(trim(old_party)) AS p, upper(trim(old_brand)) AS b, seq, 0 AS step, {v} FROM fx_so_log UNION ALL SELECT upper(trim(new_party)), upper(trim(new_brand)), seq, 1, {v} FROM fx_so_log WHERE upper(trim(old_brand)) <> upper(trim(new_brand))".format(v="coalesce(nullif(trim(new_type), ''), 'UNKNOWN') AS v")
_SO_LAST = f"SELECT p, b, coalesce(arg_min(v, (seq, step)) FILTER (upper(v) = 'RETURN'), arg_max(v, (seq, step))) AS v FROM ({_SO_STEPS}) s GROUP BY 1, 2"
add("cascade_so_type", lambda s, d: E.cascade_so_type(load(s, d).withColumn("so_type", F.when(F.col("sl_qty") < 0, "RETURN").otherwise(F.col("so_type"))), load(s, d, "fx_so_log")).groupBy("brand", "so_type").agg(_count()), f"SELECT s.brand, CASE WHEN sl_qty < 0 THEN 'RETURN' ELSE coalesce(l.v, s.so_type) END AS so_type, count(*) AS n FROM fx_sales s LEFT JOIN ({_SO_LAST}) l ON upper(trim(s.to_party_name)) = l.p AND upper(trim(s.brand)) = l.b GROUP BY 1, 2", "fx_sales", "fx_so_log")


def _edited(s, d) -> DataFrame:
    """The type master after edits, the fact that follows, and the events, as counts."""
    types = load(s, d, _TYPES)
    cells = types.where("id % 10 = 1").selectExpr("id", "stack(3, 1, 'type', 'OTHER', 2, 'type', if(id % 20 = 1, ' LAST ', 'OTHER'), 3, 'party_name', if(id % 30 = 1, concat(party_name, ' X'), party_name)) AS (seq, column_name, value)")
    master, fact, events = E.edit_master_rows("customer_type_master", types, load(s, d), cells)
    each = [master.groupBy(F.concat(F.lit("master "), "type").alias("kind")), fact.groupBy(F.concat(F.lit("fact "), F.coalesce("business_type", F.lit("none"))).alias("kind")), events.groupBy(F.concat_ws(" ", F.lit("event"), F.col("seq").cast("string"), "column_name", F.when(F.col("column_name") == "type", F.concat_ws(" ", "before", "after"))).alias("kind"))]
    return each[0].agg(_count()).unionByName(each[1].agg(_count())).unionByName(each[2].agg(_count()))


_T = f"SELECT *, CASE WHEN id % 20 = 1 THEN 'LAST' WHEN id % 10 = 1 THEN 'OTHER' ELSE type END AS now FROM {_TYPES}"
add("edit_master_row", _edited, f"""SELECT concat('master ', now) AS kind, count(*) AS n FROM ({_T}) t GROUP BY 1
UNION ALL SELECT concat('fact ', coalesce(CASE WHEN t.id % 10 = 1 AND (s.business_type IS NULL OR upper(trim(s.business_type)) = upper(t.type)) THEN t.now ELSE s.business_type END, 'none')), count(*) FROM fx_sales s LEFT JOIN ({_T}) t ON {_norm('s.to_party_name')} = upper(t.party_name) GROUP BY 1
UNION ALL SELECT concat('event 1 type ', type, ' OTHER'), count(*) FROM {_TYPES} WHERE id % 10 = 1 GROUP BY 1
UNION ALL SELECT 'event 2 type OTHER LAST', count(*) AS n FROM {_TYPES} WHERE id % 20 = 1 HAVING count(*) > 0 UNION ALL SELECT 'event 3 party_name', count(*) AS n FROM {_TYPES} WHERE id % 30 = 1 HAVING count(*) > 0""", "fx_sales", _TYPES)


# Stored partitions.
def _deleted(s, d) -> DataFrame:
    facts.sink_fact(load(s, d), at := scratch.folder(s))
    stored.delete_range(s, at, "1997-01-01", "2021-06-30")
    return _total(s.read.parquet(at), F.lit(True))


def _purged(s, d) -> DataFrame:
    stored.sink_ledger(load(s, d, "fx_event"), at := scratch.folder(s))
    stored.purge_jobs(s, at, "1997-01-01")
    return s.read.parquet(at).groupBy("status").agg(_count())


add("delete_range", _deleted, f"SELECT {AGG} FROM fx_sales WHERE NOT coalesce(bill_date BETWEEN DATE '1997-01-01' AND DATE '2021-06-30', false)")
add("purge_old_jobs", _purged, "SELECT status, count(*) AS n FROM fx_event WHERE NOT coalesce(status IN ('completed', 'failed', 'cancelled') AND ended < DATE '1997-01-01' - 90, false) GROUP BY 1", "fx_event")


# Keyed merges.
def _merged(s, d) -> DataFrame:
    """The order master, one row a key, in buckets, after an upload with several rows a key, keys that are new, and blanks."""
    orders = load(s, d, _SO).groupBy(*M.SO_KEY).agg(F.max_by(F.struct("type_of_order", "so_order_date", "id"), F.struct("so_order_date", "id")).alias("x")).select(*M.SO_KEY, "x.*")
    stored.store_bucketed(orders, name := f"so_master_{uuid.uuid4().hex}", M.SO_KEY, 8, scratch.folder(s))
    return M.upsert_so_master(s.table(name), load(s, d, "fx_so_upload"), "seq", 8)


_BEST = f"SELECT party_name, brand, fy, type_of_order, so_order_date, id FROM (SELECT *, row_number() OVER (PARTITION BY party_name, brand, fy ORDER BY so_order_date DESC, id DESC) AS n FROM {_SO}) m WHERE n = 1"
_UP = "SELECT upper(trim(party_name)) AS party_name, upper(trim(brand)) AS brand, fy, arg_max(nullif(trim(type_of_order), ''), seq) AS type_of_order FROM fx_so_upload GROUP BY 1, 2, 3"
add("upsert_so_master", _merged, f"SELECT coalesce(u.party_name, m.party_name) AS party_name, coalesce(u.brand, m.brand) AS brand, coalesce(u.fy, m.fy) AS fy, coalesce(u.type_of_order, m.type_of_order) AS type_of_order, so_order_date, id FROM ({_BEST}) m FULL JOIN ({_UP}) u ON m.party_name = u.party_name AND m.brand = u.brand AND m.fy = u.fy", _SO, "fx_so_upload")
add("upsert_party_grouping", lambda s, d: M.upsert_party_grouping(load(s, d, _GROUPS), load(s, d, "fx_party_log").selectExpr("seq", "old_party AS to_party_name", "new_group AS party_grouped", "new_count AS party_name_for_count"), "seq").select("to_party_name", "party_grouped", "party_name_for_count"), f"WITH u AS (SELECT old_party AS p, coalesce(nullif(trim(new_group), ''), old_party) AS g, coalesce(nullif(trim(new_count), ''), old_party) AS c FROM (SELECT *, row_number() OVER (PARTITION BY old_party ORDER BY seq DESC) AS n FROM fx_party_log) x WHERE n = 1) SELECT to_party_name, party_grouped, party_name_for_count FROM {_GROUPS} WHERE to_party_name NOT IN (SELECT p FROM u) UNION ALL SELECT p, g, c FROM u", _GROUPS, "fx_party_log")


# Rollups.
def _key(cols) -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]


def _nine(s, d) -> DataFrame:
    """All rows of all stored rollups: rollup, key, its totals and rows."""
    at = R.refresh(L.lookup_agent(load(s, d), load(s, d, _AGENTS)), scratch.folder(s))
    out = []
    for n in (*R.ROLLUPS, "all_dims"):
        df = s.read.parquet(f"{at}/{n}")
        sums = list(R.SUMS.values()) if n in R.ROLLUPS else ["sum_net_amount", "sum_amount_before_tax", "sum_sl_qty"]
        by = R.dims(n) if n in R.ROLLUPS else [c for c in df.columns if not c.startswith("sum_") and c != "fact_row_count"]
        key = F.concat_ws("|", *_key(by)) if n in R.ROLLUPS else F.concat_ws("|", *_key(("bill_no", "item_no", "agent_name_final", "scheme")))
        totals = R.grouped(df.select(key.alias("key"), *sums, "fact_row_count", F.lit(1).alias("one")), ["key"], {**dict(zip(sums, R.SUMS.values(), strict=True)), "one": "rows"}, "fact_row_count")
        out.append(totals.select(F.lit(n).alias("rollup"), "key", *(F.col(t).cast("decimal(38,4)").alias(t) for t in R.SUMS.values()), F.col("fact_row_count").alias("n"), "rows"))
    got = out[0]
    for x in out[1:]:
        got = got.unionByName(x)
    return got


def _nine_sql() -> str:
    def text(c: str) -> str:
        own = "CAST(CAST(date_trunc('month', bill_date) AS DATE) AS VARCHAR)" if c == "bill_month" else f"nullif(trim({c}),'')" if c in R.TIMES else f"CAST({c} AS VARCHAR)"
        return f"coalesce({own}, '-')"

    sums = "CAST(sum(net_amount) AS DECIMAL(38,4)) AS total_net, CAST(sum(amount_before_tax) AS DECIMAL(38,4)) AS total_before_tax, CAST(sum(sl_qty) AS DECIMAL(38,4)) AS total_qty, CAST(count(*) AS BIGINT) AS n"
    out = [f"SELECT '{n}' AS rollup, concat_ws('|', {', '.join(map(text, R.dims(n)))}) AS key, {sums}, CAST(1 AS BIGINT) AS rows FROM ({_AGENT}) x WHERE {NOT_TOTAL} GROUP BY 2" for n in R.ROLLUPS]
    wide = ", ".join(map(text, ("bill_no", "item_no", "agent_name_final", "scheme")))
    out.append(f"SELECT 'all_dims', concat_ws('|', {wide}), {sums}, CAST(count(DISTINCT w) AS BIGINT) FROM (SELECT *, (to_party_name, bill_date, sale_order_no, shade_name, size, units_pack, rate_unit, sl_qty, gross_amount, amount_before_tax, net_amount, item_sub_cat, branch, brand, month, fy) AS w FROM ({_AGENT}) y) x GROUP BY 2")
    return " UNION ALL ".join(out)


add("refresh_rollups", _nine, _nine_sql(), "fx_sales", _AGENTS)


def _kept(fact: DataFrame, *columns: str) -> DataFrame:
    """Columns of the fact, stored: a check reads them several times."""
    fact.select(*columns).write.option("compression", "zstd").parquet(at := scratch.folder(fact.sparkSession))
    scratch.released(fact.sparkSession)
    return fact.sparkSession.read.parquet(at)


def _checked(s, d) -> DataFrame:
    """The check of no rollup, of one without the last year, and of a whole one. Each rollup goes after its check."""
    made = load(s, d).withColumn("fy", X.fy_axis())
    fact = _kept(made, *(c for c in made.columns if c != "id"))
    last = fact.agg(F.max("fy")).first()[0]
    out = R.check_fresh(fact, scratch.folder(s)).withColumn("kind", F.lit("none"))
    for kind, df in (("old", fact.where(F.col("fy") < last)), ("whole", fact)):
        R.refresh(df, at := scratch.folder(s), ("all_dims",), kept=True)
        out = out.unionByName(scratch.checkpointed(R.check_fresh(fact, at).withColumn("kind", F.lit(kind))))
        stored.remove(s, at)
    return out


_Y = f"SELECT f AS fy, count(*) AS src, count(DISTINCT w) AS mv FROM (SELECT {FY_AXIS} AS f, (branch, month, mmm, region, state, district, city, business_type, party_grouped, to_party_name, brand, agent_name, bill_no, bill_date, item_no, shade_name, size, units_pack, rate_unit, sl_qty, gross_amount, amount_before_tax, net_amount, sale_order_no, sale_order_date, item_sub_cat, so_type, scheme) AS w FROM fx_sales) x WHERE f IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 1"
add("check_rollup_fresh", _checked, f"SELECT fy, src AS src_rows, CASE kind WHEN 'whole' THEN mv ELSE 0 END AS mv_rows, kind <> 'whole' AS stale, kind = 'none' AS skipped, kind FROM ({_Y}) y, (SELECT unnest(['none', 'old', 'whole']) AS kind) k")


def _joined(s, d) -> DataFrame:
    fact = _kept(load(s, d).withColumn("fy", X.fy_axis()), "fy", "branch")
    whole = R.freshness(fact, fact.groupBy("fy", "branch").agg(_count()))
    return whole.unionByName(R.freshness(fact, fact.where("fy < '1998-99'").groupBy("fy", "branch").agg(_count())))


_B = f"SELECT f AS fy, count(*) AS src_rows, count(DISTINCT coalesce(branch, '-')) AS mv FROM (SELECT {FY_AXIS} AS f, branch FROM fx_sales) x WHERE f IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 1"
add("join_freshness", _joined, f"SELECT fy, src_rows, mv AS mv_rows, false AS stale FROM ({_B}) a UNION ALL SELECT fy, src_rows, 0, true FROM ({_B}) b")


def rolled(s, d, only=("branch_brand", "state_month", "state_branch_brand_month")) -> str:
    """Folder of stored rollups for the queries that read them."""
    R.refresh(load(s, d), at := scratch.folder(s), only, wide=False)
    return at


#: Pivots that stored rollups answer, two of them by time, and one with a filter that none has.
_CITY, _BRANDS = [{"field": "city", "operator": "in", "values": ["CITY BUILDING"]}], [{"field": "brand", "operator": "in", "values": ["IC", "RF", "Rare Wool"]}]
PIVOTS = ((["branch", "brand"], _BRANDS), (["state", "month"], []), (["fy", "brand"], []), (["branch", "brand"], _CITY))


def answered(s, d, at: str, pivots=PIVOTS) -> DataFrame:
    """Pivots from the rollups at a folder, or from the fact."""
    fact, out = load(s, d), []
    for by, filters in pivots:
        got = R.pivot_from_rollup(fact, at, by, _V, filters)
        out.append(got.select(F.lit("+".join(by) + (" city" if filters is _CITY else "")).alias("pivot"), F.col(f"d_{by[0]}").alias("a"), F.col(f"d_{by[1]}").alias("b"), *(f"{a}_{f}" for f, a in _V)))
    return reduce(DataFrame.unionByName, out)


_BB = "nullif(trim(branch),'') AS a, nullif(trim(brand),'') AS b"
add("pivot_from_rollup", lambda s, d: answered(s, d, rolled(s, d)), f"SELECT 'branch+brand' AS pivot, {_BB}, {_VALUES} AND brand IN ('IC', 'RF', 'Rare Wool') GROUP BY 2, 3 UNION ALL SELECT 'state+month', nullif(trim(state),'') AS a, {MONTH_AXIS} AS b, {_VALUES} GROUP BY 2, 3 UNION ALL SELECT 'fy+brand', {FY_AXIS} AS a, nullif(trim(brand),'') AS b, {_VALUES} GROUP BY 2, 3 UNION ALL SELECT 'branch+brand city', {_BB}, {_VALUES} AND city = 'CITY BUILDING' GROUP BY 2, 3")


def _distinct(s, d) -> DataFrame:
    """Lists of values with where they came from."""
    at, fact = rolled(s, d, ("branch_brand", "state_month")), load(s, d)
    found = [(f, *R.distinct_source(fact, at, f)) for f in ("branch", "state", "month", "city")]
    of_fact = P.distinct_lists(fact, [f for f, _, name in found if name == "fact"], f"{scratch.folder(s)}/values")
    lists = [(f, name, of_fact[f] if name == "fact" else P.distinct_values(df, f)) for f, df, name in found]
    out = [df.select(F.lit(f).alias("field"), F.lit(name).alias("source"), "value") for f, name, df in lists]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


add("distinct_from_rollup", _distinct, f"SELECT DISTINCT 'branch' AS field, 'branch_brand' AS source, trim(branch) AS value FROM fx_sales WHERE trim(branch) <> '' AND {NOT_TOTAL} UNION ALL SELECT DISTINCT 'state', 'state_month', trim(state) FROM fx_sales WHERE trim(state) <> '' AND {NOT_TOTAL} UNION ALL SELECT DISTINCT 'month', 'fact', {MONTH_AXIS} AS m FROM fx_sales WHERE {MONTH_AXIS} IS NOT NULL UNION ALL SELECT DISTINCT 'city', 'fact', trim(city) FROM fx_sales WHERE trim(city) <> ''")
