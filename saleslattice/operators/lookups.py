"""Enrichment lookups: left joins to de-duplicated masters. A master is broadcast only if Spark's own size check allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def dedupe(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of each key in the order."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def _two_keys(df: DataFrame, master: DataFrame, name: str, key, fields: list[str], prefix: str, last: bool = False, order: str = "id") -> DataFrame:
    """df with prefix+field of the master's row of the same key, else of the same key without M/S prefix on either side. One
    aggregate gives both values of each key, and both joins read it."""
    both = F.array(F.struct(F.lit(True).alias("exact"), key(F.col(name)).alias("k")), F.struct(F.lit(False).alias("exact"), F.coalesce(X.party_alias_keys(F.col(name)), key(F.col(name))).alias("k")))
    keys = master.select(F.explode(both).alias("x"), F.struct(*fields).alias("v"), F.col(order).alias("o")).where("x.k <> ''")
    pick = F.max_by if last else F.min_by
    known = keys.groupBy("x.k").agg(pick("v", F.when(F.col("x.exact"), F.col("o"))).alias("e"), F.min_by("v", F.when(~F.col("x.exact"), F.col("o"))).alias("a"))
    first, alias = known.select(F.col("k").alias("_k1"), F.col("e").alias("_v1")), known.select(F.col("k").alias("_k2"), F.col("a").alias("_v2"))
    party = F.col("to_party_name")
    out = df.withColumns({"_p": key(party), "_a": F.coalesce(X.party_alias_keys(party), key(party))})
    out = out.join(first, F.col("_p") == F.col("_k1"), "left").join(alias, F.col("_a") == F.col("_k2"), "left")
    return out.withColumns({f"{prefix}{f}": F.coalesce(F.col(f"_v1.{f}"), F.col(f"_v2.{f}")) for f in fields} | {f"{prefix}hit": F.col("_v1").isNotNull() | F.col("_v2").isNotNull()}).drop("_p", "_a", "_k1", "_k2", "_v1", "_v2")


def lookup_region(df: DataFrame, regions: DataFrame) -> DataFrame:
    m = dedupe(regions.select(X.norm_key(F.col("state")).alias("_s"), F.col("region").alias("_r")), "_s", [F.asc("_r")])
    return df.withColumn("_k", X.norm_key(F.col("state"))).join(m, F.col("_k") == F.col("_s"), "left").withColumn("region", F.coalesce("_r", "region")).drop("_k", "_s", "_r")


def _find_place(df: DataFrame, parties: DataFrame) -> DataFrame:
    return _two_keys(df, parties, "account_name", X.normalize_party, ["district", "pin_code"], "_p_", order="account_name")


def _place(df: DataFrame) -> DataFrame:
    return df.withColumns({"district": F.coalesce("_p_district", "district"), "pin_code": F.coalesce("_p_pin_code", "pin_code")}).drop("_p_district", "_p_pin_code", "_p_hit")


def lookup_party_master(df: DataFrame, parties: DataFrame) -> DataFrame:
    return _place(_find_place(df, parties))


def _find_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    return _two_keys(df, groups.withColumnRenamed("to_party_name", "party"), "party", X.normalize_party, ["party_grouped", "party_name_for_count"], "_m_", last=True)


def lookup_party_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    return _group(_find_group(df, groups))


def _group(got: DataFrame) -> DataFrame:
    party, blank = F.trim("to_party_name"), X.null_if_blank(F.col("to_party_name")).isNull()
    group = F.when(F.col("_m_hit"), X.first_non_blank(F.col("_m_party_grouped"), F.col("party_grouped"), party)).otherwise(party)
    count = F.when(F.col("_m_hit"), X.first_non_blank(F.col("_m_party_name_for_count"), F.col("party_name_for_count"), party)).otherwise(X.first_non_blank(F.col("party_name_for_count"), party))
    return got.withColumns({"party_grouped": F.when(blank, F.col("party_grouped")).otherwise(group), "party_name_for_count": F.when(blank, F.col("party_name_for_count")).otherwise(count)}).drop("_m_party_grouped", "_m_party_name_for_count", "_m_hit")


def lookup_party_group_report(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Group and count name of parties that the master knows; other rows stay as they are."""
    got = _find_group(df, groups)
    hit, party = F.col("_m_hit"), F.col("to_party_name")
    group = F.when(hit, F.coalesce("_m_party_grouped", party)).otherwise(F.col("party_grouped"))
    count = F.when(hit, F.coalesce("_m_party_name_for_count", "party_name_for_count", party)).otherwise(F.col("party_name_for_count"))
    return got.withColumns({"party_grouped": group, "party_name_for_count": count}).drop("_m_party_grouped", "_m_party_name_for_count", "_m_hit")


def seed_regions(states: DataFrame, regions: DataFrame, master: DataFrame) -> DataFrame:
    """The region master with the reference states (state, region_id) that it lacks; regions are of id, region."""
    known = master.select("state", "region")
    named = states.join(regions.withColumnRenamed("id", "region_id"), "region_id").select("state", "region")
    return known.unionByName(named.join(known.select("state"), "state", "left_anti"))


def display_agent(df: DataFrame, agents: DataFrame) -> DataFrame:
    """Agent names as shown: the correction, else the final name; rows without a final name take the master's name for
    the agent, else the agent, else the correction."""
    old = df.withColumns({"_f": X.null_if_blank(F.col("agent_name_final")), "_c": X.null_if_blank(F.col("agent_names_correction"))})
    got = lookup_agent(old, agents)
    found = F.coalesce(F.col("agent_name_final"), F.col("_c"))
    return got.withColumns({"agent_names_correction": F.when(F.col("_f").isNotNull(), F.coalesce("_c", "_f")).otherwise(found), "agent_name_final": F.coalesce("_f", found)}).drop("_f", "_c")


def enrich_display(df: DataFrame, masters: dict[str, DataFrame], complete: bool = False) -> DataFrame:
    """Rows as shown: the types of parties from the master, sub-category from scheme where blank, time from the dates.
    complete: the rows hold all of this already, so only total rows go. Total rows are told by the names as shown."""
    from .filters import not_total_grid

    if complete:
        return df.where(not_total_grid(df))
    out = _named(lookup_region(_with_names(df, masters), masters["region"])).withColumn("_t", X.temporal_fallback_numeric())
    time = {c: F.coalesce(F.col(f"_t.{c}"), F.col(c)) for c in ("fy", "month", "mmm")}
    shown = out.withColumns(time | {"branch": X.branch_rule(F.col("branch"), F.col("brand")), "business_type": F.col("master_type"), "item_sub_cat": X.first_non_blank(F.col("item_sub_cat"), F.col("scheme")), "item_with_shade": X.item_with_shade(F.col("item_no"), F.col("shade_name"))}).drop("_t", "master_type")
    return shown.where(not_total_grid(shown))


def _find_agent(df: DataFrame, agents: DataFrame) -> DataFrame:
    keys = agents.select("id", "combined_name", F.explode(F.array(F.struct(F.lit(0).alias("o"), X.agent_exact_key(F.col("agent_name")).alias("k")), F.struct(F.lit(1).alias("o"), X.agent_norm_key(F.col("agent_name")).alias("k")))).alias("x"))
    m = dedupe(keys.select("id", "combined_name", "x.o", "x.k"), "k", [F.asc("id"), F.asc("o")])
    a, b = m.select(F.col("k").alias("_k1"), F.col("combined_name").alias("_c1")), m.select(F.col("k").alias("_k2"), F.col("combined_name").alias("_c2"))
    out = df.withColumns({"_e": X.agent_exact_key(F.col("agent_name")), "_n": X.agent_norm_key(F.col("agent_name"))}).join(a, F.col("_e") == F.col("_k1"), "left").join(b, F.col("_n") == F.col("_k2"), "left")
    return out.withColumn("_agent", X.first_non_blank(F.col("_c1"), F.col("_c2"), F.col("agent_name"))).drop("_e", "_n", "_k1", "_k2", "_c1", "_c2")


def _agent(df: DataFrame) -> DataFrame:
    return df.withColumns({"agent_name_final": F.col("_agent"), "agent_names_correction": F.col("_agent")}).drop("_agent")


def lookup_agent(df: DataFrame, agents: DataFrame) -> DataFrame:
    return _agent(_find_agent(df, agents))


def _find_type(df: DataFrame, types: DataFrame) -> DataFrame:
    return _two_keys(df, types.select("id", "party_name", X.clean_type(F.col("type")).alias("kind")), "party_name", X.normalize_party, ["kind"], "_t_", last=True)


def _type(df: DataFrame) -> DataFrame:
    return df.withColumn("master_type", F.coalesce("_t_kind", F.lit("RETAILER"))).drop("_t_kind", "_t_hit")


def lookup_customer_type(df: DataFrame, types: DataFrame) -> DataFrame:
    """df with master_type; a miss is RETAILER."""
    return _type(by_party(df, lambda names: _find_type(names, types)))


def so_type_latest(orders: DataFrame) -> DataFrame:
    """party_key and so_type, the type of the party's latest order."""
    return orders.groupBy(X.normalize_party(F.col("party_name")).alias("party_key")).agg(F.max_by(X.clean_type(F.col("type_of_order")), F.struct("so_order_date", "id")).alias("so_type"))


def _find_latest(df: DataFrame, orders: DataFrame) -> DataFrame:
    latest = so_type_latest(orders).toDF("_lp", "so_latest")
    return df.withColumn("_n", X.normalize_party(F.col("to_party_name"))).join(latest, F.col("_n") == F.col("_lp"), "left").drop("_n", "_lp")


def _exact_orders(orders: DataFrame) -> DataFrame:
    return orders.groupBy(X.norm_key(F.col("party_name")).alias("_xp"), X.norm_key(F.col("brand")).alias("_xb"), F.trim("fy").alias("_xf")).agg(F.max_by(X.clean_type(F.col("type_of_order")), F.struct("so_order_date", "id")).alias("so_exact"))


def _find_exact(df: DataFrame, orders: DataFrame) -> DataFrame:
    exact = _exact_orders(orders)
    out = df.withColumns({"_p": X.norm_key(F.col("to_party_name")), "_b": X.canonical_brand(F.col("brand")), "_f": F.trim("fy")})
    return out.join(exact, (F.col("_p") == F.col("_xp")) & (F.col("_b") == F.col("_xb")) & (F.col("_f") == F.col("_xf")), "left").drop("_p", "_b", "_f", "_xp", "_xb", "_xf")


def lookup_so_master(df: DataFrame, orders: DataFrame) -> DataFrame:
    """df with so_exact (type of the party's order of the brand and year) and so_latest (of the party's latest order)."""
    return _find_latest(_find_exact(df, orders), orders)


def by_party(df: DataFrame, find) -> DataFrame:
    """df with the columns that find adds to its distinct party names: keys are taken of each name once, and df is joined once,
    by the name as it is."""
    found = find(df.select("to_party_name").where("to_party_name is not null").distinct()).withColumnRenamed("to_party_name", "_party")
    return df.join(found, F.col("to_party_name") == F.col("_party"), "left").drop("_party")


def _find_orders(names: DataFrame, orders: DataFrame) -> DataFrame:
    """names with _orders, the map of brand and year to the type of the party's order."""
    each = _exact_orders(orders).where("_xf is not null").groupBy("_xp").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("_xb").alias("b"), F.col("_xf").alias("f")), "so_exact"))).alias("_orders"))
    return names.withColumn("_n", X.norm_key(F.col("to_party_name"))).join(each, F.col("_n") == F.col("_xp"), "left").drop("_n", "_xp")


def _with_names(df: DataFrame, masters: dict[str, DataFrame]) -> DataFrame:
    """df with what the masters hold of its parties and agents, for _named and, with orders, so_latest and _orders. All that
    depends on the party is one join of df. Agents are joined row by row: Spark broadcasts their master where it is small, and
    df need not be shuffled by a second name."""
    def of_party(names):
        out = _find_type(_find_group(_find_place(names, masters["party"]), masters["group"]), masters["type"])
        return _find_orders(_find_latest(out, masters["so"]), masters["so"]) if "so" in masters else out

    return by_party(_find_agent(df, masters["agent"]), of_party)


def _named(df: DataFrame) -> DataFrame:
    return _type(_agent(_group(_place(df))))


def enrich_fact(df: DataFrame, masters: dict[str, DataFrame]) -> DataFrame:
    """Import enrichment, in order: branch, fiscal time, brand, region, party, group, agent, item, types."""
    d = F.col("bill_date")
    out = _with_names(df, masters).withColumns({"branch": X.branch_rule(F.col("branch"), F.col("brand")), "fy": F.coalesce(X.null_if_blank(F.col("fy")), X.fy_of_date(d)), "month": F.coalesce(X.null_if_blank(F.col("month")), X.month_label(d)), "mmm": F.coalesce(X.null_if_blank(F.col("mmm")), X.mmm_label(d))})
    out = out.withColumn("brand", X.canonical_brand(F.col("brand")))
    out = _named(lookup_region(out, masters["region"])).withColumn("so_exact", F.try_element_at("_orders", F.struct(F.col("brand").alias("b"), F.trim("fy").alias("f"))))
    kind = F.coalesce(X.clean_type(F.col("business_type")), F.col("master_type"))
    channel = (F.upper(F.trim("branch")) == "ITALIAN CHANNEL") & (F.upper(kind) == "RETAILER")
    so = F.when(F.col("sl_qty") <= 0, "RETURN").when(F.col("brand") == "RISHAB FABRICS", "NO SCHEME").otherwise(F.coalesce("so_exact", "so_latest", X.null_if_blank(F.col("so_type")), F.lit("UNKNOWN")))
    return out.withColumns({"item_with_shade": X.item_with_shade(F.col("item_no"), F.col("shade_name")), "business_type": F.when(channel, "DISTRIBUTOR").otherwise(kind), "goods_type": X.goods_type(F.col("sale_order_no")), "so_type": so}).drop("master_type", "so_exact", "so_latest", "_orders")
