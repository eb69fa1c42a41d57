"""Logs of master edits: applied to the fact at once, with the result of one edit after the other.

A log has a row an edit: seq, its order (edits of one seq are in the order of their other columns), and the edited master
row's values before (old_...) and after (new_...). Each edit stands for the updates of the fact that a master edit causes.
Where an update sets a value whatever stands there, a key's last update wins. Where it depends on the value (types, orders)
or moves rows to another key (renamed agents), the log is folded first, by key or along its chains; the fact is read once
and joined with what is left. Names are compared trimmed and in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.scratch import checkpointed


def _text(name: str) -> Column:
    """Trimmed text, blank for null."""
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _at(log: DataFrame) -> Column:
    """Order of an edit, by seq and then by all it says."""
    return F.struct("seq", *sorted(c for c in log.columns if c != "seq"))


def _updates(log: DataFrame, old: list[str], new: list[str], **values: Column) -> DataFrame:
    """key (array), at, step, free and the values: an update of the old key (step 0), and one of the new key (step 1) where
    that is another. Keys with a blank part have none."""
    def key(names: list[str]) -> Column:
        return F.array(*(F.upper(_text(c)) for c in names))

    steps = F.array(F.struct(F.lit(0).alias("step"), key(old).alias("key")), F.when(F.array(*map(_text, new)) != F.array(*map(_text, old)), F.struct(F.lit(1).alias("step"), key(new).alias("key"))))
    each = log.select(_at(log).alias("at"), F.explode(steps).alias("x"), *(v.alias(n) for n, v in values.items()))
    return each.where("x is not null").select("at", "x.step", "x.key", *values).where(~F.array_contains("key", ""))


def _joined(fact: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """fact with the columns of found, whose key (array) is that of the fact's key columns."""
    at = found.select(*(F.get("key", F.lit(i)).alias(f"_k{i}") for i in range(len(keys))), *(c for c in found.columns if c != "key"))
    on = [X.norm_key(F.col(k)) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return fact.join(at, on, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def _set_last(fact: DataFrame, keys: list[str], updates: DataFrame, values: list[str]) -> DataFrame:
    """fact with the values of its key's last update."""
    last = updates.groupBy("key").agg(F.max_by(F.struct(*values), F.struct("at", "step")).alias("_new"))
    out = _joined(fact, keys, last)
    return out.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in values}).select(*fact.columns)


def cascade_region(fact: DataFrame, log: DataFrame) -> DataFrame:
    """log: seq, old_state, new_state, new_region. The region goes to rows of the old and of the new state."""
    return _set_last(fact, ["state"], _updates(log, ["old_state"], ["new_state"], region=F.trim("new_region")), ["region"])


def cascade_party_grouping(fact: DataFrame, log: DataFrame) -> DataFrame:
    """log: seq, old_party, new_party, new_group, new_count. Both go to rows of the old and of the new party."""
    updates = _updates(log, ["old_party"], ["new_party"], party_grouped=F.trim("new_group"), party_name_for_count=F.trim("new_count"))
    return _set_last(fact, ["to_party_name"], updates, ["party_grouped", "party_name_for_count"])


def cascade_customer_type(fact: DataFrame, log: DataFrame) -> DataFrame:
    """log: seq, old_party, new_party, old_type, new_type. Rows of the old party that have no type, or the old one (any, if the
    old type is blank), take the new type; rows of a new party all do.

    A key's updates before the last that asks for no type are dropped; what is left of them is folded over each row."""
    updates = _updates(log, ["old_party"], ["new_party"], was=F.upper(_text("old_type")), type=F.nullif(_text("new_type"), F.lit("")))
    free = (F.col("step") == 1) | (F.col("was") == "")
    each = F.struct("at", "step", free.alias("free"), "was", "type")
    by_key = updates.groupBy("key").agg(F.max(F.when(free, F.struct("at", "step"))).alias("_cut"), F.array_sort(F.collect_list(each)).alias("_all"))
    kept = by_key.select("key", F.filter("_all", lambda x: F.col("_cut").isNull() | (F.struct(x["at"].alias("at"), x["step"].alias("step")) >= F.col("_cut"))).alias("_all"))
    some = kept.select("key", F.transform("_all", lambda x: F.struct(x["free"].alias("free"), x["was"].alias("was"), x["type"].alias("type"))).alias("_new"))
    out = _joined(fact, ["to_party_name"], some)
    final = F.aggregate("_new", F.col("business_type"), lambda now, x: F.when(x["free"] | now.isNull() | (F.upper(F.trim(now)) == x["was"]), x["type"]).otherwise(now))
    return out.withColumn("business_type", F.when(F.col("_new").isNotNull(), final).otherwise(F.col("business_type"))).select(*fact.columns)


def cascade_so_type(fact: DataFrame, log: DataFrame) -> DataFrame:
    """log: seq, old_party, old_brand, new_party, new_brand, new_type. The type (UNKNOWN if blank) goes to rows of the old and of
    the new party and brand, never over RETURN, be it the row's own or an earlier edit's."""
    kind = F.coalesce(F.nullif(_text("new_type"), F.lit("")), F.lit("UNKNOWN"))
    updates = _updates(log, ["old_party", "old_brand"], ["new_party", "new_brand"], kind=kind)
    order = F.struct("at", "step")
    ends = F.min_by(F.when(F.upper("kind") == "RETURN", F.col("kind")), F.when(F.upper("kind") == "RETURN", order))
    last = updates.groupBy("key").agg(F.coalesce(ends, F.max_by("kind", order)).alias("_new"))
    open_ = F.col("_new").isNotNull() & ~F.coalesce(F.upper("so_type") == "RETURN", F.lit(False))
    return _joined(fact, ["to_party_name", "brand"], last).withColumn("so_type", F.when(open_, F.col("_new")).otherwise(F.col("so_type"))).select(*fact.columns)


def _departures(arrivals: DataFrame, moves: DataFrame) -> DataFrame:
    """arrivals (key, at, ...) with next: at of the first of moves (key, at) from their key that is later. A null at is before
    all. By one running window a key."""
    rest = [c for c in arrivals.columns if c not in ("key", "at")]
    a = arrivals.select("key", "at", F.lit(True).alias("_here"), F.struct(*rest).alias("_rest") if rest else F.lit(None).cast("struct<x:int>").alias("_rest"))
    kind = a.schema["_rest"].dataType
    both = a.unionByName(moves.select("key", "at", F.lit(False).alias("_here"), F.lit(None).cast(kind).alias("_rest")))
    later = Window.partitionBy("key").orderBy(F.desc_nulls_last("at"), F.desc("_here")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("next", F.last(F.when(~F.col("_here"), F.col("at")), ignorenulls=True).over(later)).where("_here")
    return seen.select("key", "at", *(F.col(f"_rest.{c}").alias(c) for c in rest), "next")


def _ends(moves: DataFrame) -> DataFrame:
    """at and end of moves (at, key, to): at of the last move of the chain that starts with it. Pointers double each round."""
    nodes = _departures(moves.where("to is not null").select(F.col("to").alias("key"), "at"), moves.select("key", "at"))
    now = checkpointed(moves.select("at").join(nodes.select("at", "next"), "at", "left").select("at", F.coalesce("next", "at").alias("end")))
    while True:
        far = now.select(F.col("at").alias("_a"), F.col("end").alias("_e"))
        new = checkpointed(now.join(far, F.col("end") == F.col("_a")).select("at", F.col("_e").alias("end"), (F.col("_e") != F.col("end")).alias("moved")))
        now = new.select("at", "end")
        if new.where("moved").isEmpty():
            return now


def cascade_agent(fact: DataFrame, log: DataFrame) -> DataFrame:
    """log: seq, old_agent, new_agent, old_combined, new_combined. An edit renames the agent's rows, if both names are there and
    differ, and gives the combined name to rows of the new name (the old, if there is no new one). An edit without any agent
    name gives it to rows whose correction or final name is the old combined name, if it is another."""
    log = checkpointed(log.distinct())
    old, new, was, combined = (_text(c) for c in ("old_agent", "new_agent", "old_combined", "new_combined"))
    each = log.select(_at(log).alias("at"), old.alias("old"), new.alias("new"), was.alias("was"), F.nullif(combined, F.lit("")).alias("combined"))
    moves = each.where("old <> '' and new <> '' and old <> new").select("at", F.upper("old").alias("key"), F.upper("new").alias("to"), F.col("new").alias("name"))
    given = each.where("new <> '' or old <> ''").select(F.upper(F.when(F.col("new") != "", F.col("new")).otherwise(F.col("old"))).alias("key"), "at", "combined")
    last = given.groupBy("key").agg(F.max_by("combined", "at").alias("combined"), F.max("at").alias("at"))
    # where each old name's rows end up: its first move's chain
    ended = _ends(moves).join(moves.select(F.col("at").alias("end"), F.col("to").alias("final"), "name"), "end").select("at", "final", "name")
    first = moves.groupBy("key").agg(F.min("at").alias("at")).join(ended, "at").select("key", "final", "name")
    names = last.select("key", F.col("key").alias("final"), F.lit(None).cast("string").alias("name")).join(first, "key", "left_anti").unionByName(first)
    told = names.join(last.select(F.col("key").alias("final"), "combined", "at"), "final").select(F.col("key").alias("agent"), "name", F.upper(F.trim("combined")).alias("key"), "combined", "at")
    # edits without an agent move combined names, from where the rows' last own edit left them
    swaps = each.where("new = '' and old = '' and was <> coalesce(combined, '')").select("at", F.upper("was").alias("key"), F.upper("combined").alias("to"), "combined")
    swapped = checkpointed(_ends(swaps).join(swaps.select(F.col("at").alias("end"), F.col("combined").alias("value")), "end").select("at", "value"))
    told = _departures(told, swaps.select("key", "at")).join(swapped.select(F.col("at").alias("next"), F.lit(True).alias("moved"), "value"), "next", "left")
    told = told.select(F.array("agent").alias("key"), F.struct("name", F.when(F.col("moved"), F.col("value")).otherwise(F.col("combined")).alias("combined")).alias("_new"))
    out = _joined(fact, ["agent_name"], told)
    starts = swaps.groupBy("key").agg(F.min("at").alias("at")).join(swapped, "at").select("key", F.struct("at", "value").alias("s"))
    for c, name in (("agent_names_correction", "_s1"), ("agent_name_final", "_s2")):
        out = out.join(starts.select(F.col("key").alias("_k"), F.col("s").alias(name)), F.upper(F.trim(c)) == F.col("_k"), "left").drop("_k")
    own, swap = F.col("_new").isNotNull(), F.least(F.col("_s1"), F.col("_s2"))
    both = {c: F.when(own, F.col("_new.combined")).when(swap.isNotNull(), swap["value"]).otherwise(F.col(c)) for c in ("agent_names_correction", "agent_name_final")}
    return out.withColumns(both | {"agent_name": F.coalesce("_new.name", "agent_name")}).select(*fact.columns)


def images(master: DataFrame, cells: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """key, seq, before and after (structs of columns): a master row on both sides of each edit. cells: seq, key, column_name,
    value; null sets null. Cells of other columns, or of rows that the master lacks, are left out."""
    some = cells.where(F.col("column_name").isin(columns)).join(master.select(key), key, "left_semi")
    set_ = [F.max(F.when(F.col("column_name") == c, F.struct(F.lit(1).alias("n"), F.trim("value").alias("v")))).alias(c) for c in columns]
    wide = some.groupBy(key, "seq").agg(*set_)
    row = Window.partitionBy(key).orderBy("seq")
    here, past = row.rowsBetween(Window.unboundedPreceding, 0), row.rowsBetween(Window.unboundedPreceding, -1)
    seen = wide.select(key, "seq", *(F.last(c, ignorenulls=True).over(w).alias(f"{p}_{c}") for c in columns for p, w in (("a", here), ("b", past))))
    own = master.select(F.col(key).alias("_key"), *(F.col(c).cast("string").alias(f"_{c}") for c in columns))
    both = seen.join(own, F.col(key) == F.col("_key"))

    def image(p: str) -> Column:
        return F.struct(*(F.when(F.col(f"{p}_{c}").isNotNull(), F.col(f"{p}_{c}.v")).otherwise(F.col(f"_{c}")).alias(c) for c in columns))

    return both.select(key, "seq", image("b").alias("before"), image("a").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


#: How an edit of a master reads as an edit of the log, and what it does to the fact.
CASCADES = {
    "region_master": (cascade_region, {"old_state": "before.state", "new_state": "after.state", "new_region": "after.region"}),
    "party_grouping_master": (cascade_party_grouping, {"old_party": "before.to_party_name", "new_party": "after.to_party_name", "new_group": "after.party_grouped", "new_count": "after.party_name_for_count"}),
    "customer_type_master": (cascade_customer_type, {"old_party": "before.party_name", "new_party": "after.party_name", "old_type": "before.type", "new_type": "after.type"}),
    "agent_name_master": (cascade_agent, {"old_agent": "before.agent_name", "new_agent": "after.agent_name", "old_combined": "before.combined_name", "new_combined": "after.combined_name"}),
    "so_master": (cascade_so_type, {"old_party": "before.party_name", "old_brand": "before.brand", "new_party": "after.party_name", "new_brand": "after.brand", "new_type": "after.type_of_order"}),
}


def edit_master_rows(name: str, master: DataFrame, fact: DataFrame, cells: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(master, fact, events) after the edits cells (seq, key, column_name, value) of the master of that name (a key of CASCADES).
    Every column but the key and created_at may be edited; edits that change nothing leave no event and reach no row."""
    columns = [c for c in master.columns if c not in (key, "created_at")]
    done = checkpointed(images(master, cells, columns, key))
    last = done.groupBy(key).agg(F.max_by("after", "seq").alias("_new"))
    after = master.join(last, key, "left").select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}").cast(master.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in master.columns))
    changes = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"before.{c}").alias("before"), F.col(f"after.{c}").alias("after")) for c in columns))
    events = done.select(key, "seq", F.explode(changes).alias("x")).select(key, "seq", "x.*").where(~F.col("before").eqNullSafe(F.col("after")))
    run, shape = CASCADES[name]
    return after, run(fact, done.select("seq", *(F.col(c).alias(n) for n, c in shape.items()))), events
