"""Benchmark decontamination by Wu-Manber search.

``decontaminate(docs, benchmark)`` finds every run of ``n`` words of a benchmark item in whole documents. Text is
lower-cased (A-Z) and words are joined by single spaces, so that each window is one byte string. Windows of like length
share a shift table over hashed blocks; lanes of text advance together by their shifts, a zero shift looks up the
suffix block's bucket, and bytes are compared to confirm.

The benchmark's distinct windows are dealt to blocks of about ``block_bytes / 2`` text. Executors build each block's tables and
write them to a shared folder; tasks read one block at a time and search it in a chunk of documents, so that neither
the driver nor a task ever holds more of the benchmark than one block.
Null and empty texts have no words and hit nothing. Items with a null id are skipped; repeated ids count once.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import folder
from ._text import LOWER, columns, lut, pieces, sha

BITS, LANE = 22, 4096
#: Bytes of text that a task searches for one block after the other; with one block, rows go as they come.
CHUNK = 16 << 20
_FLAT = LOWER.copy()
_FLAT[~lut("alnum")] = 32
_SCHEMA = "doc_id bigint, n_words bigint, runs binary, items array<string>"


def flatten(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as " word word ", rows apart by a zero byte; and the start of each row."""
    d = len(offs) - 1
    out = np.full(len(data) + 3 * d + 8, 32, np.uint8)
    lens = np.diff(offs)
    out[np.arange(len(data)) + np.repeat(3 * np.arange(d) + 1, lens)] = _FLAT[data]
    ends = offs[1:] + 3 * np.arange(1, d + 1) - 1
    out[ends] = 0
    out = out[: ends[-1] + 1 if d else 0]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    out = out[keep]
    zero = np.flatnonzero(out == 0)
    return out, np.concatenate([[0], zero + 1])


def windows(text: str | None, n: int) -> list[bytes]:
    raw = (text or "").encode()
    if not raw:
        return []
    words = bytes(_FLAT[np.frombuffer(raw, np.uint8)]).split()
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(max(1, len(words) - n + 1))] if words else []


class Table:
    """Patterns of like length: m bytes of each take part in the shift table, with blocks of b bytes."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.b = b = 8 if m >= 32 else 6 if m >= 16 else 4 if m >= 8 else 3
        self.mask = np.uint64((1 << (8 * b)) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns) + bytes(8), np.uint8)
        view = np.ndarray(len(heads) - 7, "<u8", buffer=heads, strides=(1,))
        self.shift = np.full(1 << BITS, m - b + 1, np.uint16)
        for end in range(b, m + 1):  # later ends give smaller shifts
            keys = view[np.arange(len(patterns)) * m + end - b] & self.mask
            np.minimum.at(self.shift, self.slot(keys), m - end)
        keys = view[np.arange(len(patterns)) * m + m - b] & self.mask
        order = np.argsort(keys, kind="stable")
        self.keys, self.order, self.patterns = keys[order], order, patterns
        self.first = view[np.arange(len(patterns)) * m] & self.mask

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    def find(self, text: np.ndarray) -> list[tuple[int, int]]:
        """Start and pattern of each occurrence."""
        n, m, b = len(text), self.m, self.b
        if n < m:
            return []
        raw = np.concatenate([text, np.zeros(8, np.uint8)])
        view = np.ndarray(n, "<u8", buffer=raw, strides=(1,))
        end = np.arange(0, n - m + 1, LANE) + m
        last = np.minimum(end + LANE - 1, n)
        seen = []
        while len(end):
            step = self.shift[self.slot(view[end - b] & self.mask)]
            if len(at := end[step == 0]):
                seen.append(at)
            end = end + np.maximum(step, 1)
            if not (ok := end <= last).all():
                end, last = end[ok], last[ok]
        if not seen:
            return []
        ends = np.concatenate(seen)
        keys = view[ends - b] & self.mask
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        who = np.repeat(np.arange(len(ends)), hi - lo)
        pat = self.order[np.arange(len(who)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        at = ends[who] - m
        ok = (view[at] & self.mask) == self.first[pat]
        whole = raw.tobytes()
        return [(p, k) for p, k in zip(at[ok].tolist(), pat[ok].tolist(), strict=True) if whole.startswith(self.patterns[k], p)]


def tables(found: list[bytes]) -> list[Table]:
    groups: dict[int, list[bytes]] = {}
    for w in found:
        groups.setdefault((len(w) >= 8) + (len(w) >= 16) + (len(w) >= 32), []).append(w)
    return [Table(p) for p in groups.values()]


def _windows(n: int):
    def run(batches):
        for b in pieces(batches, "text"):
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(dict.fromkeys(windows(text, n)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item_id", "w"])

    return run


def _built(table: pa.Table) -> pa.Table:
    """A block's tables and the items of each window, packed."""
    owners = dict(zip(table["w"].to_pylist(), table["items"].to_pylist(), strict=True))
    made = zstandard.compress(pickle.dumps((tables(list(owners)), owners)), 1)
    return pa.table({"block": table["block"][:1], "made": pa.array([made], pa.binary())})


def _write_blocks(benchmark: DataFrame, n: int, block_bytes: int) -> tuple[str, list[int]]:
    """The folder of the blocks' tables, as a full URI, and the list of the blocks that Spark finds there."""
    bench = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = benchmark.sparkSession
    blocks, at = -(-size * 2 // block_bytes) or 1, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    where = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    each = bench.mapInArrow(_windows(n), "item_id string, w binary").groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    dealt = each.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks)).cast("int"))
    dealt.groupBy("block").applyInArrow(_built, "block int, made binary").write.partitionBy("block").parquet(where)
    return where, sorted(r.block for r in spark.read.schema("made binary, block int").parquet(where).select("block").distinct().collect())


def _read_block(where: str, k: int) -> tuple[list[Table], dict[bytes, list[str]]]:
    """A block's tables and owners. A block that Spark has written is there: if it isn't found, this task looks elsewhere than
    Spark, which is an error and no benchmark without windows."""
    store, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", where))
    for f in store.get_file_info(fs.FileSelector(f"{path}/block={k}")):
        if f.path.endswith(".parquet") and len(made := pq.ParquetFile(store.open_input_file(f.path)).read(["made"])["made"]):
            return pickle.loads(zstandard.decompress(made[0].as_py()))
    raise FileNotFoundError(f"block {k} of the benchmark at {where}")


def _chunks(batches, least: int) -> Iterator[list[pa.RecordBatch]]:
    """Pieces in lists of at least so many bytes, but for the last."""
    held, size = [], 0
    for b in pieces(batches, "text"):
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(where: str, blocks: list[int], new: Callable, add: Callable, finish: Callable):
    """A mapInArrow function: new(piece, text, firsts) makes a piece's state, add(state, tables, owners) takes a block's
    hits into it, finish(state) makes a batch of it."""

    def run(batches):
        held = None
        for chunk in _chunks(batches, CHUNK if len(blocks) > 1 else 0):
            states = [new(b, *flatten(*columns(b, "text"))) for b in chunk]
            for k in blocks:
                if held is None or len(blocks) > 1:
                    held = None  # goes before the next comes
                    held = _read_block(where, k)
                for s in states:
                    add(s, *held)
            yield from map(finish, states)

    return run


class _Hits:
    def __init__(self, b: pa.RecordBatch, text: np.ndarray, firsts: np.ndarray):
        self.b, self.text, self.firsts = b, text, firsts
        head = np.zeros(len(text), bool)
        head[:-1] = (text[:-1] == 32) & (text[1:] != 32) & (text[1:] != 0)
        self.words = np.concatenate([[0], np.cumsum(head, dtype=np.int32)])
        self.spans: dict[int, list] = {}
        self.items: dict[int, set] = {}

    def add(self, made: list[Table], owners: dict[bytes, list[str]]) -> None:
        for t in made:
            for at, k in t.find(self.text):
                p = t.patterns[k]
                row = int(np.searchsorted(self.firsts, at, "right")) - 1
                first = int(self.words[at] - self.words[self.firsts[row]])
                self.spans.setdefault(row, []).append((first, first + p.count(b" ") - 1))
                self.items.setdefault(row, set()).update(owners[p])

    def finish(self) -> pa.RecordBatch:
        runs: list = [None] * self.b.num_rows
        ids: list = [None] * self.b.num_rows
        for r, x in self.spans.items():
            merged: list[list[int]] = []
            for lo, hi in sorted(x):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            runs[r], ids[r] = np.array(merged, np.int64).tobytes(), sorted(self.items[r])
        n_words = np.diff(self.words[self.firsts]).astype(np.int64)
        return pa.RecordBatch.from_arrays([self.b.column(0), pa.array(n_words), pa.array(runs, pa.binary()), pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "n_words", "runs", "items"])


class _Clean:
    def __init__(self, b: pa.RecordBatch, text: np.ndarray, firsts: np.ndarray):
        self.b, self.text, self.firsts, self.keep = b, text, firsts, np.ones(b.num_rows, bool)

    def add(self, made: list[Table], owners: dict[bytes, list[str]]) -> None:
        hit = [at for t in made for at, _ in t.find(self.text)]
        self.keep[np.searchsorted(self.firsts, np.array(hit, np.int64), "right") - 1] = False

    def finish(self) -> pa.RecordBatch:
        return self.b.filter(pa.array(self.keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, runs (int64 pairs: first and past-last hit word, apart and in order) and items (ids, sorted)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_search(*_write_blocks(benchmark, n, block_bytes), _Hits, _Hits.add, _Hits.finish), _SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """The rows of docs, with all columns, in which no window occurs."""
    return docs.mapInArrow(_search(*_write_blocks(benchmark, n, block_bytes), _Clean, _Clean.add, _Clean.finish), docs.schema)


def _digests(batches):
    for b in batches:
        runs, items = b.column(2).to_pylist(), b.column(3).to_pylist()
        hits = [int(np.diff(np.frombuffer(r, np.int64).reshape(-1, 2)).sum()) if r else 0 for r in runs]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.int64()), pa.array([len(x or ()) for x in items], pa.int64()), pa.array([sha(",".join(x or ()).encode()) for x in items]), pa.array([h > 0 for h in hits])], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, bench).mapInArrow(_digests, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")
