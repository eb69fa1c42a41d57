"""Conversation structure repair: the cheapest edits that make the roles' initials ``(s?(ua)+)?``.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert of an empty user or assistant row (2). Blank rows
and repeats of an earlier role and text must be deleted; a truncated row that stays adds 1.

A row is one of nine symbols (its initial and fault), and the costs of all that is left, by state of the pattern, are a
vector of four numbers. Less their least, only a few such vectors can occur, so what a block of ``BLOCK`` symbols makes of
each vector is a table, made once (the method of the Four Russians). A conversation is read from its end, a block a lookup;
then each block's own vectors are made again from the one behind it, and the edits are followed from the start. Of edits of
one cost, those whose initials are ASCII-least are taken, decided row by row against exact costs.

On Spark: rows are dealt by ranges of conversation and place, so that a conversation of any size is spread; each task
keeps one byte a row, and a conversation's parts meet as such bytes. The repaired rows are a sorted stream in which the
conversation's edits come before its rows: no conversation is held in memory. Its rows do pass one task at that, as one
hash of its text must.

Rows are in order of turn (null first), then of role and of the text's hash; equal rows are interchangeable, and all but the
first are repeats. Null roles and texts are one space. A null key is one conversation. Roles are told by their first
character; an empty role has none and fits nowhere. Empty tables have no conversations. Other columns are not kept.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4
GONE, SYMBOLS, STATES = 8, 9, 4
SPACE = " \t\n\x0b\x0c\r"
#: (state, initial) to state. States: nothing yet, after s, after u, after a. Initials: s, u, a, other.
KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: State after the one user or assistant row that may come next.
NEXT = (2, 2, 3, 2)
_FAR = 1 << 20


def _inserted(costs: list[int]) -> list[int]:
    for _ in range(STATES):
        costs = [min(costs[q], 2 + costs[NEXT[q]]) for q in range(STATES)]
    return costs


def before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Costs by state before a row from those after it. symbol: initial, and 4 more if truncated; GONE must be deleted."""
    costs = [3 + c for c in after]
    if symbol < GONE:
        more = symbol // 4
        for q in range(STATES):
            kept = KEEP.get((q, symbol % 4))
            costs[q] = min(costs[q], 2 + more + after[NEXT[q]], _FAR if kept is None else more + after[kept])
    return _inserted(costs)


def _edits(symbol: int, after: tuple[int, ...], q: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits from state q up to a row's own, and the state then."""
    costs, done = before(symbol, after), ""
    while True:
        if costs[q] == 3 + after[q]:
            return done + "D", q
        if costs[q] == 2 + costs[NEXT[q]]:
            done, q = done + "I", NEXT[q]
            continue
        kept = KEEP.get((q, symbol % 4))
        if kept is not None and costs[q] == symbol // 4 + after[kept]:
            return done + "K", kept
        return done + "R", NEXT[q]


@functools.cache
def tables() -> tuple:
    """vectors, one and one_add (vector and cost before a symbol), many and many_add (before a block), moves (edits)."""
    vectors = [tuple(_inserted([0, _FAR, _FAR, 0]))]
    known, one, one_add = {vectors[0]: 0}, [], []
    for v in vectors:  # grows
        made = [before(s, v) for s in range(SYMBOLS)]
        low = [min(m) for m in made]
        at = []
        for m, n in zip(made, low, strict=True):
            w = tuple(c - n for c in m)
            if w not in known:
                known[w] = len(vectors)
                vectors.append(w)
            at.append(known[w])
        one.append(at)
        one_add.append(low)
    to, add = np.array(one), np.array(one_add)
    many, many_add = to, add
    for _ in range(BLOCK - 1):
        many_add = np.concatenate([many_add + add[many, s] for s in range(SYMBOLS)], axis=1)
        many = np.concatenate([to[many, s] for s in range(SYMBOLS)], axis=1)
    moves = [[[_edits(s, v, q) for q in range(STATES)] for s in range(SYMBOLS)] for v in vectors]
    return vectors, one, one_add, many.tolist() if len(vectors) * SYMBOLS**BLOCK < 1 << 20 else many, many_add, moves


_POWERS = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def audit(symbols: bytes) -> tuple[int, str]:
    """Cost and initials of the edits of a conversation's rows."""
    vectors, one, one_add, many, many_add, moves = tables()
    head = len(symbols) % BLOCK
    codes = (np.frombuffer(symbols, np.uint8)[head:].reshape(-1, BLOCK) @ _POWERS).tolist()
    v, cost, behind = 0, 0, []
    for code in reversed(codes):
        behind.append(v)
        cost += int(many_add[v, code])
        v = many[v][code]
    behind.append(v)
    for s in reversed(symbols[:head]):
        cost += one_add[v][s]
        v = one[v][s]
    cost += vectors[v][0]
    done, q = [], 0
    for at in range(head - BLOCK if head else 0, len(symbols), BLOCK):
        block, v = symbols[max(at, 0) : at + BLOCK], behind[(len(symbols) - at - BLOCK) // BLOCK]
        after = [v]
        for s in reversed(block[1:]):
            v = one[v][s]
            after.append(v)
        for s, v in zip(block, reversed(after), strict=True):
            text, q = moves[v][s][q]
            done.append(text)
    return cost, "".join(done) + ("", "II", "I", "")[q]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _rows(df: DataFrame, key: str, turn: str, role: str, text: str, live: str | None) -> DataFrame:
    """conv, live, turn, role, text. live: a column that is false for rows that only name their conversation."""
    return df.select(_quoted(key).alias("conv"), (_quoted(live) if live else F.lit(True)).alias("live"), _quoted(turn).cast("long").alias("turn"), F.coalesce(_quoted(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(_quoted(text).cast("string"), F.lit(" ")).alias("text"))


def faults(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: str | None = None) -> DataFrame:
    """conv, live, turn, role, h1, h2 (hashes of role and text), initial (0 to 3) and fault: 0 none, 1 blank, 2 later than
    an equal row (of another turn), 3 truncated."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    rows = _rows(df, key, turn, role, text, live).select("conv", "live", "turn", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), last.alias("last"))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    often = rows.where("live and last <> ''").groupBy("conv", "h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first < end")
    # the join's key differs from the group's, so that both sides are dealt anew and a hot text can be split
    often = often.select(F.col("conv").alias("_c"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "first", F.xxhash64("conv", "h1", "h2").alias("_k"))
    left = rows.withColumn("_l", F.xxhash64("conv", "h1", "h2"))
    both = left.join(often.hint("merge"), (left["_l"] == often["_k"]) & left["conv"].eqNullSafe(often["_c"]) & (left["h1"] == often["_1"]) & (left["h2"] == often["_2"]), "left")
    fault = F.when(F.col("last") == "", 1).when(F.col("first").isNotNull() & (place != F.col("first")), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    return both.select("conv", "live", "turn", "role", "h1", "h2", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).cast("int").alias("initial"), fault.cast("int").alias("fault"))


class _Part:
    """What is known of a run of a conversation's rows; run() adds rows or the part that follows."""

    def __init__(self):
        self.symbols, self.blank, self.repeat, self.cut, self.illegal = bytearray(), 0, 0, 0, 0
        self.first = self.last = self.low = self.high = None
        self.turns = 0

    def _joined(self, row: tuple) -> tuple[bool, bool]:
        """Whether a row that follows repeats the last one, and whether its turn is new."""
        return self.last is not None and self.last[:3] == row[:3], self.last is None or self.last[0] != row[0]

    def add(self, turn, h1: int, h2: int, initial: int, fault: int) -> None:
        row = (turn, h1, h2, initial)
        same, new = self._joined(row)
        if same and fault != 1:
            fault = 2
        if self.last is not None and (self.last[3], initial) not in LEGAL:
            self.illegal += 1
        self.symbols.append(GONE if fault in (1, 2) else initial + 4 * (fault == 3))
        self.blank += fault == 1
        self.repeat += fault == 2
        self.cut += fault == 3
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += new
        self.first, self.last = self.first or row, row

    def follow(self, x: _Part) -> None:
        if x.first is None:
            return
        same, new = self._joined(x.first)
        if self.last is not None and (self.last[3], x.first[3]) not in LEGAL:
            self.illegal += 1
        if same and x.symbols[0] != GONE:
            self.repeat += 1
            self.cut -= x.symbols[0] >= 4
            x.symbols[0] = GONE
        self.symbols += x.symbols
        for name in ("blank", "repeat", "cut", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(x, name))
        self.turns += x.turns - (x.first[0] is not None and not new)
        if x.low is not None:
            self.low, self.high = x.low if self.low is None else self.low, x.high
        self.first, self.last = self.first or x.first, x.last


#: Pairs of initials that may be adjacent: su, ua, au.
LEGAL = {(0, 1), (1, 2), (2, 1)}
_PART = "part int, symbols binary, blank bigint, repeat bigint, cut bigint, illegal bigint, turns bigint, low bigint, high bigint, first struct<t:bigint,a:bigint,b:bigint,i:int>, last struct<t:bigint,a:bigint,b:bigint,i:int>"
_PLAN = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(df: DataFrame, rest: str) -> tuple[str, pa.Schema]:
    """Schema of conv and the rest, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"conv {df.schema['conv'].dataType.simpleString()}, {rest}"
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def _by_conversation(batches, read, made, schema: pa.Schema, most: int = 1000):
    """Batches of made(conv, x) for each run of rows with one conv; read(x or None, row) gives x."""
    out, conv, x = [], None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if x is not None and row[0] != conv:
                out.append(made(conv, x))
                x = None
                if len(out) >= most:
                    yield _table(out, schema)
                    out = []
            conv, x = row[0], read(x, row)
    if x is not None:
        out.append(made(conv, x))
    if out:
        yield _table(out, schema)


def plans(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: str | None = None) -> DataFrame:
    """One row a conversation: conv, gaps (turns missing between the first and the last), blank, duplicate, truncated,
    illegal (adjacent initials other than su, ua, au), cost and audit (initials of the edits)."""
    rows = faults(df, key, turn, role, text, live)
    ddl, schema = _arrow(rows, _PART)
    done_ddl, done = _arrow(rows, _PLAN)

    def struct(row):
        return row and {"t": row[0], "a": row[1], "b": row[2], "i": row[3]}

    def parts(batches):
        part = TaskContext.get().partitionId()

        def read(x, row):
            x = x or _Part()
            if row[1]:
                x.add(*row[2:])
            return x

        def made(conv, x):
            return conv, part, bytes(x.symbols), x.blank, x.repeat, x.cut, x.illegal, x.turns, x.low, x.high, struct(x.first), struct(x.last)

        yield from _by_conversation(batches, read, made, schema)

    def whole(batches):
        def read(x, row):
            y = _Part()
            y.symbols, (y.blank, y.repeat, y.cut, y.illegal, y.turns, y.low, y.high) = bytearray(row[2]), row[3:10]
            y.first, y.last = (r and tuple(r.values()) for r in row[10:])
            if x is None:
                return y
            x.follow(y)
            return x

        def made(conv, x):
            cost, edits = audit(bytes(x.symbols))
            return conv, 0 if x.low is None else x.high - x.low + 1 - x.turns, x.blank, x.repeat, x.cut, x.illegal, cost, edits

        yield from _by_conversation(batches, read, made, done)

    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv", "turn", "role", "h1", "h2"]
    spread = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", "live", "turn", "h1", "h2", "initial", "fault")
    return spread.mapInArrow(parts, ddl).repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(whole, done_ddl)


def repaired(df: DataFrame, planned: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: str | None = None) -> DataFrame:
    """conv, place (from 0), turn (null for inserted rows), role, text and edit (K, R or I) of the rows that are left, each
    conversation in one partition and in order."""
    rows = _rows(df, key, turn, role, text, live).where("live").select("conv", F.lit(1).alias("kind"), "turn", "role", "text", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    none = F.lit(None).cast("string")
    heads = planned.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    ddl, schema = _arrow(rows, "place bigint, turn bigint, role string, text string, edit string")
    names = {"u": "user", "a": "assistant"}

    def run(batches):
        edits, at, place, q, conv, out, size = "", 0, 0, 0, None, [], 0

        def inserts(letter="I"):
            """Rows that come before the next row, or at the end."""
            nonlocal at, place, q
            while at < len(edits) and edits[at] == letter:
                q = NEXT[q]
                out.append((conv, place, None, names["-sua"[q]], "", "I"))
                at, place = at + 1, place + 1

        for batch in batches:
            for c, kind, t, r, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if kind == 0:
                    inserts()
                    edits, at, place, q, conv = x, 0, 0, 0, c
                    continue
                inserts()
                letter, at = edits[at], at + 1
                if letter == "D":
                    continue
                q = KEEP[q, "sua".index(r[0])] if letter == "K" else NEXT[q]
                out.append((c, place, t, r if letter == "K" else names["-sua"[q]], x, letter))
                place, size = place + 1, size + len(x)
                if len(out) >= 2000 or size > 4 << 20:
                    yield _table(out, schema)
                    out, size = [], 0
        inserts()
        if out:
            yield _table(out, schema)

    both = heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "h1", "h2")
    return both.select("conv", "kind", "turn", "role", "text").mapInArrow(run, ddl)


def digests(rows: DataFrame) -> DataFrame:
    """conv and repaired_sha256 of repaired()'s rows: role:text, joined by newlines."""
    ddl, schema = _arrow(rows, "repaired_sha256 string")

    def read(x, row):
        if x is None:
            x = hashlib.sha256()
        else:
            x.update(b"\n")
        x.update(f"{row[1]}:{row[2]}".encode())
        return x

    return rows.select("conv", "role", "text").mapInArrow(lambda batches: _by_conversation(batches, read, lambda c, x: (c, x.hexdigest()), schema), ddl)


def damaged(df: DataFrame) -> DataFrame:
    """conversations with one row in four damaged, by crc32 of conv_id:turn modulo 20: 0 drops it (_live is false), 1
    empties its text, 2 removes its sentence ends, 3 repeats it, 4 sets role user. Nulls are one space."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    base = df.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("k"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return base.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("k") != 0).alias("_live"), copies.alias("_copy")).drop("_copy")


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: str | None = None) -> tuple[DataFrame, DataFrame]:
    """plans() and repaired() of the conversations. live: a column that is false for rows which only name their conversation."""
    planned = plans(df, key, turn, role, text, live)
    return planned, repaired(df, planned, key, turn, role, text, live)


def op13_structure_repair(spark, sf_dir: str) -> DataFrame:
    planned, rows = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), live="_live")
    found = digests(rows).withColumnRenamed("conv", "_c")
    both = planned.join(found.hint("merge"), planned["conv"].eqNullSafe(found["_c"]), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return both.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
