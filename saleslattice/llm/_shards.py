"""Exact repeats of fixed windows of tokens across a corpus, without shuffling the windows.

Documents are packed into compressed shards, written once. Each window of ``size`` tokens has a minimizer, the least
hash of its ``gram``-token grams, so equal windows have equal minimizers, and neighbouring windows share one. Then:

1. each shard sends its distinct minimizers, as sorted keys by bucket; buckets merge the shards' sorted keys and answer
   one bit a key: seen in more than one shard;
2. each shard sends the distinct stretches of windows whose minimizer others share (or that it repeats itself), with
   the first place of each; a bucket's index (suffix array, FM-index) finds equal windows among the distinct stretches
   and answers one bit a window: its first place in the corpus is this shard's;
3. shards apply the bits to all their windows.

A stretch shared by any number of documents reaches a bucket once a shard, so copies are never paired. Stretches of one
minimizer that differ (at the edges of a hot passage, or around a common gram) would gather in its bucket: where shards
hold more than ``CROWD`` of them besides one a shard, a second bit a key says so, and the minimizer's windows are sent
one by one, dealt by the hash of the window, which equal windows share. Shards have bounded sizes, buckets bounded
mean sizes and crowds; their number grows with the input. Contents of one hash are compared token by token before they
count as one (words by 64-bit hashes, bytes as they are). Lost executors: shards and
bits are checkpointed, all else is recomputed from them.

Order: by id, then by place in the text; a null id is before all others; rows with equal ids are equals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder
from ._text import columns, grams, hash_spans, inside, lut, mix, pieces, ranges, spans

SHARD_BYTES, BUCKET_BYTES, LONGEST, CROWD = 4 << 20, 8 << 20, 256, 4096
#: Stands for a null id within shards; it is before all others, and a real id of this value is one with it.
NO_ID = np.iinfo(np.int64).min
_SHARD = "shard bigint, n bigint, ids binary, lens binary, blob binary"
_KEYS = "shard bigint, bucket int, keys binary, more binary"
_BITS = "shard bigint, bucket int, bits binary"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder: spark.checkpoint.dir, or a new temporary folder in local sessions
    that name none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or folder(df.sparkSession))
    return df.checkpoint()


def _ints(x: np.ndarray, kind) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x, kind).tobytes(), 1)


def _of(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def pack(docs: DataFrame, key: str, col: str) -> DataFrame:
    def run(batches):
        task, made, ids, lens, blobs, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), pa.array([size]), pa.array([_ints(np.concatenate(ids), "<i8")]), pa.array([_ints(np.concatenate(lens), "<i8")]), pa.array([zstandard.compress(b"".join(blobs), 3)])], names=["shard", "n", "ids", "lens", "blob"])

        for b in pieces(batches, "text", SHARD_BYTES // 4):
            data, offs = columns(b, "text")
            if size and size + len(data) > SHARD_BYTES:
                yield row()
                made, ids, lens, blobs, size = made + 1, [], [], [], 0
            ids.append(np.array([NO_ID if x is None else x for x in b.column(0).to_pylist()], np.int64))
            lens.append(np.diff(offs))
            blobs.append(data.tobytes())
            size += len(data)
        if ids:
            yield row()

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{col}`").cast("string").alias("text")).mapInArrow(run, _SHARD)


@dataclass
class Shard:
    """A shard's tokens and its stretches: runs of windows with one minimizer."""

    ids: np.ndarray
    data: np.ndarray
    offs: np.ndarray
    starts: np.ndarray | None  # of words; None where bytes are the tokens
    ends: np.ndarray | None
    firsts: np.ndarray  # each document's first token
    at: np.ndarray  # first window of each stretch
    n: np.ndarray  # windows of each stretch
    code: np.ndarray  # bucket << 32 | key
    hashes: np.ndarray | None


def unpack(row: dict, plan: Plan) -> Shard:
    ids, lens = _of(row["ids"], "<i8"), _of(row["lens"], "<i8")
    data = np.frombuffer(zstandard.decompress(row["blob"]), np.uint8)
    offs = np.concatenate([[0], np.cumsum(lens)])
    k = plan.gram
    if plan.words:
        starts, ends, firsts = spans(data, offs, lut("space"))
        h = hash_spans(data, starts, ends)
        g = grams(h, k)
    else:
        starts = ends = h = None
        firsts = offs
        if len(data) >= k:
            w = np.ndarray(len(data) - 7, "<u8", buffer=data, strides=(1,))
            g = w[: len(data) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + w[k - 8 : len(data) - 7] * np.uint64(0xC2B2AE3D27D4EB4F)
            g = (g ^ (g >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        else:
            g = np.zeros(0, np.uint64)
    total, span = int(firsts[-1]), plan.size - k + 1
    if total < plan.size:
        none = np.zeros(0, np.int64)
        return Shard(ids, data, offs, starts, ends, firsts, none, none, none.astype(np.uint64), h)
    low, have = g, 1
    pos = np.arange(len(g), dtype=np.int32) if plan.words else None
    while have < span:
        step = min(have, span - have)
        left, right = low[:-step], low[step:]
        if plan.words:
            pos = np.where(left <= right, pos[:-step], pos[step:])
        low, have = np.minimum(left, right), have + step
    ok = inside(firsts, total, plan.size)
    new = ok.copy()
    # words: one place of the minimizer a stretch, so that no window is in a stretch twice
    new[1:] &= ((pos[1:] != pos[:-1]) if plan.words else (low[1:] != low[:-1])) | ~ok[:-1]
    at = np.flatnonzero(new)
    stop = np.flatnonzero(ok & ~np.concatenate([ok[1:] & ~new[1:], [False]])) + 1
    n = stop - at
    if len(n) and n.max() > LONGEST:
        parts = -(-n // LONGEST)
        inner = ranges(np.zeros(len(parts), np.int64), parts)
        at, n = np.repeat(at, parts) + inner * LONGEST, np.minimum(np.repeat(n, parts) - inner * LONGEST, LONGEST)
    return Shard(ids, data, offs, starts, ends, firsts, at, n, _code(low[at], plan), h)


@dataclass
class Plan:
    """size: tokens of a window; gram: tokens of a minimizer; index: class of each window of some stretches."""

    words: bool
    size: int
    gram: int
    index: Callable
    buckets: int = 1
    crowd: int = CROWD


def _code(hashes: np.ndarray, plan: Plan) -> np.ndarray:
    key = mix(hashes)
    return (((key >> np.uint64(33)) % np.uint64(plan.buckets)) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def _contents(s: Shard, plan: Plan, which: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each stretch's content."""
    at, end = s.at[which], (s.at + s.n + plan.size - 1)[which]
    return hash_spans(s.hashes.view(np.uint8), at * 8, end * 8, seed) if plan.words else hash_spans(s.data, at, end, seed)


def same(tokens: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> bool:
    """Whether each run of n tokens from a equals that of m from b, compared token by token, some at a time."""
    if (n != m).any():
        return False
    on = np.flatnonzero(a != b)
    for some in np.array_split(on, int(n[on].sum()) // (1 << 20) + 1):
        if not np.array_equal(tokens[ranges(a[some], n[some])], tokens[ranges(b[some], n[some])]):
            return False
    return True


def _by_bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(code, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}


def _send_keys(plan: Plan):
    """A shard's keys by bucket, and how many distinct stretches besides one each has."""

    def run(batches):
        for row in _rows(batches):
            s = unpack(row, plan)
            code, inv, n = np.unique(s.code, return_inverse=True, return_counts=True)
            again = np.flatnonzero(n[inv] > 1)
            who, h = inv[again], _contents(s, plan, again)
            order = np.lexsort((h, who))
            differs = (who[order][1:] == who[order][:-1]) & (h[order][1:] != h[order][:-1])
            more = np.bincount(who[order][1:][differs], minlength=len(code))
            cut = _by_bucket(code, plan.buckets)
            full = np.flatnonzero(np.diff(cut))
            keys = [(np.diff(code[cut[b] : cut[b + 1]].astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes() for b in full]
            extra = [_ints(x, "<u4") if (x := more[cut[b] : cut[b + 1]]).any() else None for b in full]
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array(keys, pa.binary()), pa.array(extra, pa.binary())], names=["shard", "bucket", "keys", "more"])

    return run


def _shared_keys(plan: Plan):
    """Merge the shards' sorted keys: one bit a key, set where another shard has it too, then one a key, set where its
    stretches are a crowd."""

    def run(table: pa.Table) -> pa.Table:
        sent = [np.cumsum(np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32) for x in table["keys"].to_pylist()]
        extra = [None if x is None else _of(x, "<u4") for x in table["more"].to_pylist()]
        every = np.sort(np.concatenate(sent))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        some = [(s[x > 0], x[x > 0]) for s, x in zip(sent, extra, strict=True) if x is not None]
        crowds = np.zeros(0, np.uint32)
        if some:
            key, of = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
            crowds = key[np.bincount(of, np.concatenate([x for _, x in some])) > plan.crowd]
        bits = [np.packbits(np.concatenate([_among(s, twice), _among(s, crowds)])).tobytes() for s in sent]
        return pa.table({"shard": table["shard"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    return run


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is sorted."""
    at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
    return known[at] == x if len(known) else np.zeros(len(x), bool)


def _joined_bits(got: list[dict], tag: int, counts: np.ndarray, rows: int = 1) -> np.ndarray:
    """The rows of bits of a shard's answers, each in bucket order; counts: how many in a row by bucket."""
    by = {x["bucket"]: x["bits"] for x in got if x["tag"] == tag}
    parts = [np.unpackbits(np.frombuffer(by[b], np.uint8), count=rows * c).reshape(rows, c) for b, c in enumerate(counts.tolist()) if c]
    return np.concatenate(parts, axis=1).astype(bool) if parts else np.zeros((rows, 0), bool)


@dataclass
class Sent:
    """Stretches that take part: which, their distinct contents in the order sent, and each content's first stretch."""

    which: np.ndarray
    of: np.ndarray  # content of each
    first: np.ndarray  # stretch, by content
    cut: np.ndarray  # contents by bucket


def _apart(s: Shard, plan: Plan, crowd: np.ndarray) -> Shard:
    """The shard with each window of the stretches in crowd as a stretch of its own, dealt by its hash."""
    parts = np.where(crowd, s.n, 1)
    at = np.repeat(s.at, parts) + ranges(np.zeros(len(parts), np.int64), parts)
    one = np.repeat(crowd, parts)
    out = replace(s, at=at, n=np.where(one, 1, np.repeat(s.n, parts)), code=np.repeat(s.code, parts))
    which = np.flatnonzero(one)
    out.code[which] = _code(_contents(out, plan, which), plan)
    return out


def _candidates(s: Shard, plan: Plan, got: list[dict]) -> tuple[Shard, Sent, np.ndarray, np.ndarray]:
    """The shard with its crowds apart, what is sent, and id and place of every stretch."""
    code, inv, n = np.unique(s.code, return_inverse=True, return_counts=True)
    shared, crowd = _joined_bits(got, 0, np.diff(_by_bucket(code, plan.buckets)), 2)
    sends = (shared | (n > 1))[inv]
    if crowd.any():
        crowd = crowd[inv]
        s, sends = _apart(s, plan, crowd), np.repeat(sends | crowd, np.where(crowd, s.n, 1))
    which = np.flatnonzero(sends)
    doc = np.searchsorted(s.firsts, s.at, "right") - 1
    id_, place = s.ids[doc], s.at - s.firsts[doc]
    tokens = s.hashes if plan.words else s.data
    n = s.n[which] + plan.size - 1
    h = [_contents(s, plan, which)]
    while True:
        order = np.lexsort((place[which], id_[which], *h, s.code[which]))
        new = np.ones(len(order), bool)
        new[1:] = s.code[which][order][1:] != s.code[which][order][:-1]
        for x in h:
            new[1:] |= x[order][1:] != x[order][:-1]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = which[order[new]]
        if same(tokens, s.at[which], n, s.at[first][of], (s.n[first] + plan.size - 1)[of]):
            break
        h.append(_contents(s, plan, which, len(h)))  # contents that differ had one hash
    return s, Sent(which, of, first, _by_bucket(s.code[first], plan.buckets)), id_, place


def _send_stretches(plan: Plan):
    def run(batches):
        for row in _rows(batches):
            s = unpack(row, plan)
            s, c, id_, place = _candidates(s, plan, row["got"])
            last = s.at + s.n + plan.size - 2
            lo, hi = (s.starts[s.at], s.ends[last]) if plan.words else (s.at, last + 1)
            out = []
            for b in np.flatnonzero(np.diff(c.cut)):
                f = c.first[c.cut[b] : c.cut[b + 1]]
                blob = s.data[ranges(lo[f], hi[f] - lo[f])].tobytes()
                out.append((row["shard"], int(b), _ints(s.code[f] & np.uint64(0xFFFFFFFF), "<u4"), _ints(hi[f] - lo[f], "<u4"), _ints(id_[f], "<i8"), _ints(place[f], "<i8"), zstandard.compress(blob, 3)))
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["shard", "bucket", "keys", "lens", "ids", "places", "blob"])

    return run


def _first_places(plan: Plan):
    """In a bucket: one bit a window of each stretch sent, set where no equal window comes before it."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, lens = np.concatenate([_of(r["keys"], "<u4") for r in rows]), np.concatenate([_of(r["lens"], "<u4") for r in rows]).astype(np.int64)
        ids, places = np.concatenate([_of(r["ids"], "<i8") for r in rows]), np.concatenate([_of(r["places"], "<i8") for r in rows])
        sizes = [len(_of(r["lens"], "<u4")) for r in rows]
        data = np.frombuffer(b"".join(zstandard.decompress(r["blob"]) for r in rows), np.uint8)
        offs = np.concatenate([[0], np.cumsum(lens)])
        if plan.words:
            starts, ends, firsts = spans(data, offs, lut("space"))
            tokens = hash_spans(data, starts, ends)
            flat, wide = tokens.view(np.uint8), 8
        else:
            tokens, firsts = data, offs
            flat, wide = data, 1
        h = [hash_spans(flat, firsts[:-1] * wide, firsts[1:] * wide)]
        while True:
            _, rep, of = np.unique(np.stack(h), axis=1, return_index=True, return_inverse=True) if len(h) > 1 else np.unique(h[0], return_index=True, return_inverse=True)
            of, n = of.ravel(), np.diff(firsts)
            if same(tokens, firsts[:-1], n, firsts[:-1][rep][of], n[rep][of]):
                break
            h.append(hash_spans(flat, firsts[:-1] * wide, firsts[1:] * wide, len(h)))  # stretches that differ had one hash
        # the first place of each distinct stretch
        if not plan.words:
            places = np.zeros_like(places)  # within a document bytes don't remove each other
        order = np.lexsort((places, ids, of))
        heads = np.ones(len(order), bool)
        heads[1:] = of[order][1:] != of[order][:-1]
        least = order[heads]
        tokens_of = firsts[1:] - firsts[:-1]
        wins = tokens_of[rep] - plan.size + 1
        base = np.concatenate([[0], np.cumsum(wins)])
        # first place of each window of each distinct stretch: that of the stretch, or of an equal window elsewhere
        first_id = np.repeat(ids[least], wins)
        first_at = np.repeat(places[least], wins) + (ranges(np.zeros(len(wins), np.int64), wins) if plan.words else 0)
        alike = np.bincount(np.unique(keys[rep], return_inverse=True)[1])[np.unique(keys[rep], return_inverse=True)[1]] > 1
        some = np.flatnonzero(alike)
        if len(some):
            body = tokens[ranges(firsts[rep[some]], tokens_of[rep[some]])]
            cls = plan.index(body, tokens_of[rep[some]], plan.size)
            win = ranges(base[some], wins[some])
            order = np.lexsort((first_at[win], first_id[win], cls))
            heads = np.ones(len(order), bool)
            heads[1:] = cls[order][1:] != cls[order][:-1]
            head = np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))
            src = win[order[head]]
            first_id[win[order]], first_at[win[order]] = first_id[src], first_at[src]
        mine = ranges(base[of], wins[of])
        own = np.repeat(places, wins[of]) + (ranges(np.zeros(len(of), np.int64), wins[of]) if plan.words else 0)
        flag = (first_id[mine] == np.repeat(ids, wins[of])) & (first_at[mine] == own)
        ends_ = np.cumsum(wins[of])
        cut = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.concatenate([[0], ends_])[cut]
        bits = [np.packbits(flag[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"shard": table["shard"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    return run


def removed(row: dict, plan: Plan) -> tuple[Shard, np.ndarray]:
    """A shard with its answers, and which tokens go."""
    s = unpack(row, plan)
    total = int(s.firsts[-1])
    if not len(s.at):
        return s, np.zeros(total, bool)
    s, c, id_, place = _candidates(s, plan, row["got"])
    wins = s.n[c.first]
    counts = np.add.reduceat(np.concatenate([wins, [0]]), np.minimum(c.cut[:-1], len(wins))) * (np.diff(c.cut) > 0)
    flag = _joined_bits(row["got"], 1, counts)[0]
    base = np.concatenate([[0], np.cumsum(wins)])
    same = id_[c.which] == id_[c.first[c.of]]
    if plan.words:
        same &= place[c.which] == place[c.first[c.of]]
    n = s.n[c.which]
    gone = ~(flag[ranges(base[c.of], n)] & np.repeat(same, n))
    at = ranges(s.at[c.which], n)[gone]
    mark = np.zeros(total + 1, np.int32)
    mark[: total - plan.size + 1] = np.bincount(at, minlength=total - plan.size + 1)
    mark[plan.size :] -= np.bincount(at, minlength=total - plan.size + 1)
    return s, np.cumsum(mark)[:total] > 0


def repeats(docs: DataFrame, key: str, col: str, plan: Plan, finish, schema: str) -> DataFrame:
    """finish: from (Shard, tokens removed) to a record batch of the schema."""
    spark: SparkSession = docs.sparkSession
    shards = checkpointed(pack(docs, key, col))
    size = shards.agg(F.sum("n")).first()[0] or 0
    plan.buckets, plan.crowd = max(1, -(-size // BUCKET_BYTES)), CROWD
    parts = max(plan.buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = shards.mapInArrow(_send_keys(plan), _KEYS).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_shared_keys(plan), _BITS)
    answers = checkpointed(answers.withColumn("tag", F.lit(0)))

    def with_answers(bits: DataFrame) -> DataFrame:
        own = bits.groupBy("shard").agg(F.collect_list(F.struct("tag", "bucket", "bits")).alias("got"))
        return shards.join(own, "shard", "left").withColumn("got", F.coalesce("got", F.array().cast("array<struct<tag:int,bucket:int,bits:binary>>")))

    sent = with_answers(answers).mapInArrow(_send_stretches(plan), "shard bigint, bucket int, keys binary, lens binary, ids binary, places binary, blob binary")
    firsts = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_first_places(plan), _BITS).withColumn("tag", F.lit(1))

    def run(batches):
        for row in _rows(batches):
            yield finish(*removed(row, plan))

    return with_answers(answers.unionByName(firsts)).mapInArrow(run, schema)
