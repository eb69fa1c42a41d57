"""Conversation repair against a plain program over costs and strings."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from saleslattice.llm import queries
from saleslattice.llm import structure as S

PATTERN = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_audit(rows):
    """rows: (initial, must go, truncated). Least (cost, initials of edits, final role letters) by search over the pattern."""

    @cache
    def best(i, state, inserts):
        out = [] if i < len(rows) or state not in ("", "a") else [(0, "", "")]
        if i < len(rows):
            c, gone, cut = rows[i]
            x = best(i + 1, state, 0)
            out.append((3 + x[0], "D" + x[1], x[2]))
            if not gone:
                for letter, cost, role in [("K", 0, c), ("R", 2, "u"), ("R", 2, "a")]:
                    if (to := STEP.get((state, role))) is not None:
                        x = best(i + 1, to, 0)
                        out.append((cost + cut + x[0], letter + x[1], role + x[2]))
        if inserts < 3:
            for role in "ua":
                if (to := STEP.get((state, role))) is not None:
                    x = best(i, to, inserts + 1)
                    out.append((2 + x[0], "I" + x[1], role + x[2]))
        return min(out) if out else (10**6, "", "")

    return best(0, "", 0)


def last(text):
    return WORD.findall(text)[-1:]


def plain(rows):
    """conv to result of its rows (turn, role, text), in order; dropped rows are None."""
    live = [r for r in rows if r is not None]
    turns = [t for t, _, _ in live if t is not None]
    seen, items, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in live:
        kind = "blank" if not last(text) else "duplicate" if (role, text) in seen else "truncated" if last(text)[0] not in ".!?" else None
        seen.add((role, text))
        if kind:
            counts[kind] += 1
        items.append((role[:1], kind in ("blank", "duplicate"), int(kind == "truncated")))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(items))
    cost, edits, letters = plain_audit(tuple(items))
    assert PATTERN.fullmatch(letters)
    out, i, k = [], 0, 0
    for e in edits:
        if e == "I":
            out.append({"u": "user", "a": "assistant"}[letters[k]] + ":")
            k += 1
            continue
        if e != "D":
            out.append((live[i][1] if e == "K" else {"u": "user", "a": "assistant"}[letters[k]]) + ":" + live[i][2])
            k += 1
        i += 1
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, edits, sha)


def order(row, spark_hash):
    return (row[0] is not None, row[0] or 0, row[1], *spark_hash)


def damage(rows):
    """conv_id to rows (turn, role, text) in the table's order, None for dropped ones."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        row = (turn, "user" if k == 4 else role, text)
        out.setdefault(conv, []).extend([None] if k == 0 else [row, row] if k == 3 else [row])
    return out


def test_audits():
    rng = random.Random(4)
    cases = [bytes(x) for n in range(4) for x in itertools.product(range(S.SYMBOLS), repeat=n)]
    cases += [bytes(rng.choice([0, 1, 2, 1, 2, 3, 5, 6, 8]) for _ in range(rng.randint(4, 30))) for _ in range(300)]
    for x in cases:
        rows = tuple(("suao"[s % 4] if s < S.GONE else "u", s == S.GONE, int(4 <= s < 8)) for s in x)
        assert S.audit(x) == plain_audit(rows)[:2], list(x)
    vectors = S.tables()[0]
    assert len(vectors) < 100 and all(min(v) == 0 for v in vectors)


def made(seed, n=300):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", " \t", "", "Why?  ", "x\n", ".", None, "Ends. \x0b", "nbsp\xa0", "café é"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "usher"]
    rows = []
    for conv in [None, *range(n)]:
        turn = rng.choice([0, 1, -3])
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, turn if rng.random() > 0.1 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"Text {rng.random()}."))
            turn += rng.choice([1, 1, 1, 2, 5])
    return rows


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(7, *r, "x") for r in rows], "cost int, conv_id long, turn long, role string, text string, audit string").withColumns({"_live": F.lit("no"), "live": F.lit(0), "fault": F.lit(2.0)}).repartition(parts)
    planned, left = S.repair(df)
    got = {r.conv: r for r in planned.collect()}
    texts = {r.conv: r.repaired_sha256 for r in S.digests(left).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {c: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, texts.get(c, empty)) for c, r in got.items()}


def wanted(spark, rows):
    """In the operator's order: ties of a turn by role and hashes of the text."""
    pairs = sorted({(r or "" if r is not None else " ", t if t is not None else " ") for _, _, r, t in rows})
    df = spark.createDataFrame(pairs or [("", "")], "role string, text string").select("role", "text", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"))
    hashes = {(r.role, r.text): (r.a, r.b) for r in df.collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return {c: plain(sorted(rs, key=lambda r: order(r, hashes[r[1], r[2]]))) for c, rs in by.items()}


def test_odd_rows(spark):
    rows = made(1)
    rows += [(900, 1, "user", "Twice."), (900, 1, "user", "Twice."), (900, 1, "assistant", "Tie."), (901, None, None, None), (902, 5, "user", "Long. " * 50_000), (902, 6, "assistant", "y" * 1_000_000 + ".")]
    assert run(spark, rows) == wanted(spark, rows)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Same.", "Cut", f"Own {i}.", f"Own {i}."])) for i in range(700)]
    rows += [(2, 0, "user", "Q?"), (2, 1, "assistant", "A.")] + [(3, 4, "user", "Equal rows.")] * 40
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = run(spark, rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == wanted(spark, rows)


def test_empty_and_text_keys(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([("a", 0, "user", "Hm."), ("b", 0, "user", "Hm?"), ("b", 1, "assistant", "Well.")], "conv_id string, turn int, role string, text string")
    planned, left = S.repair(df)
    assert {r.conv: r.audit for r in planned.collect()} == {"a": "KI", "b": "KK"}
    assert [tuple(r) for r in left.where("conv = 'a'").orderBy("place").collect()] == [("a", 0, 0, "user", "Hm.", "K"), ("a", 1, None, "assistant", "", "I")]


def test_query(spark, sf, tmp_path):
    odd = made(2, 120)
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").where("turn is not null").dropDuplicates(["conv_id", "turn"]).write.parquet(f"{tmp_path}/conversations.parquet")
    for d in (sf, str(tmp_path)):
        rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        want = {c: plain(sorted(rs, key=lambda r: (r is None, r and r[0]))) for c, rs in damage(rows).items()}
        got = queries()["op13_structure_repair"](spark, d).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)
