"""Batches of master edits against the same edits one after the other, on random logs with chains of renames."""

import random

import pytest

from saleslattice.operators import edits as E

NAMES = ["A", "b", " B ", "C", "c", "D", "", None, "E"]
FACT = "id long, state string, region string, to_party_name string, party_grouped string, party_name_for_count string, business_type string, brand string, so_type string, agent_name string, agent_names_correction string, agent_name_final string"
KEYS = [c.split()[0] for c in FACT.split(", ")]


def norm(x):
    return None if x is None else x.strip().upper()


def text(x):
    return "" if x is None else x.strip()


def region(row, e):
    for k in [text(e["old_state"])] + ([text(e["new_state"])] if text(e["new_state"]) != text(e["old_state"]) else []):
        if k and norm(row["state"]) == norm(k):
            row["region"] = None if e["new_region"] is None else e["new_region"].strip()


def grouping(row, e):
    for k in [text(e["old_party"])] + ([text(e["new_party"])] if text(e["new_party"]) != text(e["old_party"]) else []):
        if k and norm(row["to_party_name"]) == norm(k):
            row["party_grouped"], row["party_name_for_count"] = ((None if e[c] is None else e[c].strip()) for c in ("new_group", "new_count"))


def customer(row, e):
    old, new, was, now = (text(e[c]) for c in ("old_party", "new_party", "old_type", "new_type"))
    if old and norm(row["to_party_name"]) == norm(old) and (row["business_type"] is None or norm(row["business_type"]) == norm(was) or not was):
        row["business_type"] = now or None
    if new and new != old and norm(row["to_party_name"]) == norm(new):
        row["business_type"] = now or None


def order(row, e):
    old, new = tuple(text(e[c]).upper() for c in ("old_party", "old_brand")), tuple(text(e[c]).upper() for c in ("new_party", "new_brand"))
    for k in [old] + ([new] if new != old else []):
        if all(k) and (norm(row["to_party_name"]), norm(row["brand"])) == k and (row["so_type"] or "").upper() != "RETURN":
            row["so_type"] = text(e["new_type"]) or "UNKNOWN"


def agent(row, e):
    old, new, was, now = (text(e[c]) for c in ("old_agent", "new_agent", "old_combined", "new_combined"))
    if old and new and old != new and norm(row["agent_name"]) == norm(old):
        row["agent_name"] = new
    if new or old:
        if norm(row["agent_name"]) == norm(new or old):
            row["agent_names_correction"] = row["agent_name_final"] = now or None
    elif was != now and norm(was) in (norm(row["agent_names_correction"]), norm(row["agent_name_final"])):
        row["agent_names_correction"] = row["agent_name_final"] = now or None


CASES = {
    "region": (E.cascade_region, region, ["old_state", "new_state", "new_region"], False),
    "grouping": (E.cascade_party_grouping, grouping, ["old_party", "new_party", "new_group", "new_count"], False),
    "customer": (E.cascade_customer_type, customer, ["old_party", "new_party", "old_type", "new_type"], False),
    "order": (E.cascade_so_type, order, ["old_party", "old_brand", "new_party", "new_brand", "new_type"], False),
    "agent": (E.cascade_agent, agent, ["old_agent", "new_agent", "old_combined", "new_combined"], True),
}


def fact_rows(rng, n=150):
    return [(i, *(rng.choice([*NAMES, "Return"]) for _ in KEYS[1:])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("case", list(CASES))
def test_as_if_one_by_one(spark, case, seed):
    run, one, columns, few = CASES[case]
    rng = random.Random(seed)
    names = [*NAMES, *([] if few else ["return", "RETURN"])]
    log = [{"seq": s, **{c: rng.choice(names) for c in columns}} for s in range(rng.choice([12, 30]))]
    if case == "agent":  # a chain, and edits without an agent between
        log += [{"seq": 100 + i, "old_agent": f"n{i}", "new_agent": f"N{i + 1}", "old_combined": None, "new_combined": f"x{i % 3}"} for i in range(9)]
        log += [{"seq": s, "old_agent": " ", "new_agent": None, "old_combined": a, "new_combined": b} for s, a, b in ((90, "a", "b"), (91, "B", "q"), (200, "X2", "y"), (201, "Y", "z"), (202, "z", None))]
    rows = fact_rows(rng)
    if case == "agent":
        rows += [(1000 + i, *[None] * 8, f" N{i}", "a", None) for i in range(10)]
    df = spark.createDataFrame(rows, FACT)
    batch = spark.createDataFrame([tuple(e.values()) for e in log], "seq long, " + ", ".join(f"{c} string" for c in columns)).repartition(5)
    got = {r.id: tuple(r) for r in run(df, batch).collect()}
    for r in rows:
        row = dict(zip(KEYS, r, strict=True))
        for e in sorted(log, key=lambda e: e["seq"]):
            one(row, e)
        assert got[row["id"]] == tuple(row.values()), (case, r)
    assert len(got) == len(rows)


def test_empty_log(spark):
    df = spark.createDataFrame(fact_rows(random.Random(3), 5), FACT)
    for run, _, columns, _ in CASES.values():
        none = spark.createDataFrame([], "seq long, " + ", ".join(f"{c} string" for c in columns))
        assert sorted(map(str, run(df, none).collect())) == sorted(map(str, df.collect()))


def test_edited_rows(spark):
    """Cells of several edits of a row: images, events, the master after, and the fact along a chain of renames."""
    master = spark.createDataFrame([(1, "a1", "x"), (2, "a2", "y"), (3, None, None)], "id long, agent_name string, combined_name string")
    fact = spark.createDataFrame([("A1", None, None), ("a2", "y", "y"), ("other", "k", None)], "agent_name string, agent_names_correction string, agent_name_final string")
    cells = [(1, 1, "agent_name", " b1 "), (1, 1, "combined_name", "x"), (2, 1, "agent_name", "c1"), (3, 1, "combined_name", "z"), (4, 1, "combined_name", "z"), (2, 2, "combined_name", None), (5, 9, "agent_name", "none such"), (6, 1, "id", "7"), (7, 3, "combined_name", "k2"), (8, 3, "combined_name", None)]
    after, moved, events = E.edit_master_rows("agent_name_master", master, fact, spark.createDataFrame(cells, "seq long, id long, column_name string, value string"))
    assert sorted(map(tuple, after.collect())) == [(1, "c1", "z"), (2, "a2", None), (3, None, None)]
    assert sorted(map(tuple, events.collect())) == [(1, 1, "agent_name", "a1", "b1"), (1, 2, "agent_name", "b1", "c1"), (1, 3, "combined_name", "x", "z"), (2, 2, "combined_name", "y", None), (3, 7, "combined_name", None, "k2"), (3, 8, "combined_name", "k2", None)]
    assert sorted(map(str, map(tuple, moved.collect()))) == sorted(map(str, [("c1", "z", "z"), ("a2", None, None), ("other", "k", None)]))
