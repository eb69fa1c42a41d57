"""Maintenance of stored tables: upserts, cascades of master edits, audit, deletes and backfills. Each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .edits import cascade_so_type
from .lookups import by_party, dedupe


def folded(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key: of each column its last value that is not null, by order (and by the value where that is equal)."""
    rest = [c for c in rows.columns if c not in keys and c != order]

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*([order] if order else []), c))).alias(c)

    return rows.groupBy(*keys).agg(*map(last, rest)) if rest else rows.select(*keys).distinct()


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """target (one row a key) with rows put in by key, as if one after the other by order: a new column wins where it is not
    null. rows may hold a key more than once. Keys with a null are keys like others."""
    rest = [c for c in target.columns if c not in keys]
    t, n = target.alias("t"), folded(rows, keys, order).alias("n")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = t.join(n, on, "full")
    return both.select(*(F.coalesce(f"n.{k}", f"t.{k}").alias(k) for k in keys), *((F.coalesce(f"n.{c}", f"t.{c}") if c in rows.columns else F.col(f"t.{c}")).alias(c) for c in rest)).select(*target.columns)


#: Key of an order master; fixed values: its texts that are kept in upper case.
SO_KEY = ["party_name", "brand", "fy"]
SO_UPPER = ("party_name", "brand", "so_agent_name", "branch", "company_name")


def so_rows(rows: DataFrame) -> DataFrame:
    """Uploaded order rows as the master holds them: texts trimmed, names in upper case, blanks null. Rows without a party, brand
    or year go."""
    def clean(c: str) -> Column:
        text = X.null_if_blank(F.col(c))
        return F.upper(text) if c in SO_UPPER else text

    texts = [c for c, kind in rows.dtypes if kind == "string"]
    return rows.withColumns({c: clean(c) for c in texts}).dropna(subset=SO_KEY)


def upsert_so_master(master: DataFrame, rows: DataFrame, order: str | None = None, buckets: int | None = None) -> DataFrame:
    """The order master (unique by party, brand and year, not null, in upper case) with uploaded rows merged by that key: their
    values that are not blank win, the later row by order over the earlier.

    Where master is a table in so many buckets of the key (stored.store_bucketed), only the upload is shuffled."""
    clean = so_rows(rows)
    new = folded(clean.repartition(buckets, *SO_KEY) if buckets else clean, SO_KEY, order)
    t, n = master.alias("t"), new.alias("n")
    both = t.join(n.hint("merge"), [F.col(f"t.{k}") == F.col(f"n.{k}") for k in SO_KEY], "full")
    return both.select(*((F.coalesce(f"n.{c}", f"t.{c}") if c in new.columns else F.col(f"t.{c}")).alias(c) for c in master.columns))


def upsert_party_grouping(master: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    """The grouping master with rows' parties deleted (by the very name) and rows inserted, the last of each party by order; a
    blank group or count name is the party's name. Rows without a party go."""
    party = F.col("to_party_name")
    named = rows.where(F.trim(party) != "").withColumns({c: F.coalesce(X.null_if_blank(F.col(c)), party) for c in ("party_grouped", "party_name_for_count") if c in rows.columns})
    rest = [c for c in rows.columns if c not in ("to_party_name", order)]
    at = F.struct(*([order] if order else []), *rest)
    new = named.groupBy("to_party_name").agg(F.max_by(F.struct(*rest), at).alias("x")).select("to_party_name", "x.*")
    return master.join(new.select("to_party_name"), "to_party_name", "left_anti").unionByName(new, allowMissingColumns=True).select(*master.columns)


def replace_rows(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Delete by key, then insert."""
    return target.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def cascade(fact: DataFrame, edits: DataFrame, on: dict[str, str], field: str, new: str, only: Column | None = None) -> DataFrame:
    """fact with field set from the edit (column new) whose keys match on (fact column to edit column), normalised. Of edits of
    one key the greatest value holds."""
    e = edits.select(*(X.norm_key(F.col(b)).alias(f"_{a}") for a, b in on.items()), F.col(new).alias("_new")).groupBy(*(f"_{a}" for a in on)).agg(F.max("_new").alias("_new")).withColumn("_hit", F.lit(True))
    cond = [X.norm_key(F.col(a)) == F.col(f"_{a}") for a in on]
    hit = F.col("_hit").isNotNull() & (only if only is not None else F.lit(True))
    return fact.join(e, cond, "left").withColumn(field, F.when(hit, F.col("_new")).otherwise(F.col(field))).select(*fact.columns)


def audit_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One event for each changed column, values as text."""
    cols = [c for c in before.columns if c != key and c in after.columns]
    b, a = before.alias("b"), after.alias("a")
    changes = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"b.{c}").cast("string").alias("before"), F.col(f"a.{c}").cast("string").alias("after")) for c in cols))
    both = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}")).select(F.col(f"b.{key}").alias(key), F.explode(changes).alias("x"))
    return both.select(key, "x.*").where(~F.col("before").eqNullSafe(F.col("after")))


def delete_range(fact: DataFrame, first: str, last: str) -> DataFrame:
    d = F.col("bill_date").cast("date")
    return fact.where(~F.coalesce(d.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False)))


def delete_range_preview(fact: DataFrame, first: str, last: str) -> DataFrame:
    return fact.where(F.col("bill_date").cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).agg(F.count(F.lit(1)).alias("n"))


def backfill_so_type(fact: DataFrame, orders: DataFrame) -> DataFrame:
    kind = X.clean_type(F.col("type_of_order"))
    latest = orders.groupBy(X.backfill_key(F.col("party_name")).alias("_k")).agg(F.max_by(kind, F.struct("so_order_date", "id")).alias("_t"))
    out = by_party(fact, lambda names: names.withColumn("_n", X.backfill_key(F.col("to_party_name"))).join(latest, F.col("_n") == F.col("_k"), "left").drop("_n", "_k"))
    return out.withColumn("so_type", F.when(F.col("sl_qty") <= 0, "RETURN").otherwise(F.col("_t"))).select(*fact.columns)


def lookup_conflicts(orders: DataFrame) -> DataFrame:
    """Keys whose orders name more than one type."""
    kind = X.clean_type(F.col("type_of_order"))
    return orders.groupBy(X.backfill_key(F.col("party_name")).alias("party_key")).agg(F.countDistinct(kind).alias("types")).where("types > 1")


def match_stats(fact: DataFrame, orders: DataFrame, top: int = 20) -> DataFrame:
    """kind, party_key, n: rows processed, matched and unmatched, and the unmatched keys with most rows."""
    keys = orders.select(X.backfill_key(F.col("party_name")).alias("_k")).distinct()
    by_key = fact.groupBy(X.backfill_key(F.col("to_party_name")).alias("party_key")).agg(F.count(F.lit(1)).alias("n"))
    seen = by_key.join(keys, F.col("party_key") == F.col("_k"), "left").withColumn("hit", F.col("_k").isNotNull())
    kinds = F.array(F.lit("processed"), F.when(F.col("hit"), "matched").otherwise("unmatched"))
    counts = seen.select(F.explode(kinds).alias("kind"), "n").groupBy("kind").agg(F.sum("n").alias("n"))
    first = seen.where(~F.col("hit") & F.col("party_key").isNotNull()).orderBy(F.desc("n"), "party_key").limit(top)
    return counts.select("kind", F.lit("").alias("party_key"), "n").unionByName(first.select(F.lit("top unmatched").alias("kind"), "party_key", "n"))


def unmatched_parties(fact: DataFrame, groups: DataFrame) -> DataFrame:
    left = fact.select(X.normalize_party(F.col("to_party_name")).alias("party_key")).where("party_key <> ''").distinct()
    return left.join(groups.select(X.normalize_party(F.col("to_party_name")).alias("party_key")), "party_key", "left_anti")


def new_parties(fact: DataFrame, groups: DataFrame) -> DataFrame:
    """Parties absent from the grouping master, first spelling each, with a derived group."""
    key = F.lower(F.trim("to_party_name"))
    names = fact.select("to_party_name", key.alias("k")).where("k <> ''").distinct()
    fresh = dedupe(names.join(groups.select(key.alias("k")), "k", "left_anti"), "k", [F.asc("to_party_name")])
    return fresh.select(F.trim("to_party_name").alias("to_party_name"), X.derive_group_name(F.col("to_party_name")).alias("party_grouped"), F.trim("to_party_name").alias("party_name_for_count"))


def job_state(events: DataFrame) -> DataFrame:
    """Latest event of each job; queued_at and started_at keep their first known value."""
    last = F.max_by(F.struct("status", "processed_rows", "failed_rows"), "ts").alias("x")
    return events.groupBy("id").agg(last, F.min("queued_at").alias("queued_at"), F.min("started_at").alias("started_at")).select("id", "x.*", "queued_at", "started_at")


def edit_siblings(orders: DataFrame, edits: DataFrame) -> DataFrame:
    """The order master with an edit's type on every row of its party and brand."""
    return cascade(orders, edits, {"party_name": "party_name", "brand": "brand"}, "type_of_order", "type_of_order")


def edit_so_master(orders: DataFrame, fact: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, fact, audit) after the edits (party_name, brand, type_of_order): every year's rows of a party and brand
    change, each change is an audit line, and the fact's types follow."""
    after = edit_siblings(orders, edits)
    log = edits.select(F.lit(0).alias("seq"), *(F.col("party_name").alias(c) for c in ("old_party", "new_party")), *(F.col("brand").alias(c) for c in ("old_brand", "new_brand")), F.col("type_of_order").alias("new_type"))
    return after, cascade_so_type(fact, log), audit_diff(orders, after, "id")


def backfill_district(fact: DataFrame, parties: DataFrame) -> DataFrame:
    """fact with blank districts from the party master: the same name, else the same name without M/S prefixes."""
    from .lookups import lookup_party_master

    got = lookup_party_master(fact.withColumn("_old", F.struct("district", "pin_code")), parties)
    return got.withColumns({"district": F.coalesce(X.null_if_blank(F.col("_old.district")), F.col("district")), "pin_code": F.col("_old.pin_code")}).select(*fact.columns)


def union_masters(*masters: DataFrame | None) -> DataFrame:
    """All rows of the masters that exist; columns that one lacks are null there."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (m for m in masters if m is not None))
