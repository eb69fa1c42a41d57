"""Hard-negative mining over candidate blocks on a Hilbert curve with zone maps.

Vectors become integers (floor of ``scale`` times each component) and are ordered along a Hilbert curve through a grid of
their ``CURVE`` most variable components, whose means and deviations are taken over all rows. The ordered rows are written
as Parquet, a block of ``BLOCK`` vectors a row, each with its least and greatest value by component (its zone map) and its
least id; ``BUNDLE`` blocks in order are a bundle with a zone map of its own.

A search is a window of scores of an anchor: the best few rows of its own label (positives), or of others between two bounds
(negatives). By interval arithmetic a zone map bounds the inner product of every vector in it: an anchor goes to a bundle, and
reads a block there, only if the bound meets a window and can still better the worst of what the window holds. Each anchor
searches its own bundle first, so that windows are filled when the others' bounds are looked at. All scores are exact
integers, and no block that could hold a result is left out.

Tasks stream: a bundle's blocks, then packs of anchors one by one; a pack's windows, then the bundles' findings. Crowds of
equal vectors are cut into blocks like any other rows.

Keys and labels are integers. Rows with a null key or label, a null vector, or a null or non-finite component take no part;
all others do, vectors without components too. Vectors of different lengths have no score with each other. Rows of an
anchor's own key are not its partners; otherwise rows of one key are rows, and an anchor that is there twice is searched for
twice. A score that does not fit 64 bits is an error. Other columns are not read. An empty table has no results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder
from ._shards import checkpointed

CURVE, CURVE_BITS = 15, 4
BLOCK, BUNDLE, PACK, PAGE = 512, 32, 256, 4096
LENGTHS = 64
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells (each under 2**bits)."""
    x = cells.T.astype(np.int64).copy()
    if not len(x):
        return np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for row in x:
            on = (row >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(on, low, swap)
            row ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = (out << 1) | ((row >> b) & 1)
    return out


def _binary(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    """One binary of 8-byte values a row."""
    at = np.concatenate([[0], np.cumsum(lens)]) * 8
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _of(b: bytes, kind=np.int64, width: int | None = None) -> np.ndarray:
    x = np.frombuffer(b, kind)
    return x if width is None else x.reshape(-1, width)


def vectors(df: DataFrame, key: str, vec: str, label: str, anchor: Column, scale: float) -> DataFrame:
    """id, label, anchor, dim and q (components as integers in 64-bit floats) of the rows that take part."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vec}`").cast("array<double>").alias("v"))

    def run(batches):
        for b in batches:
            lens = pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = b.column(3).flatten()
            x = np.floor(scale * np.asarray(flat.to_numpy(zero_copy_only=False), np.float64))  # null is nan
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            end = np.cumsum(lens)
            good = bad[end] == bad[end - lens]
            part = b.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lens[good], pa.int32()), _binary(x[np.repeat(good, lens)], lens[good])], names=["id", "label", "anchor", "dim", "q"])

    some = rows.where("id is not null and label is not null and v is not null")
    return some.mapInArrow(run, "id bigint, label bigint, anchor boolean, dim int, q binary")


def grids(rows: DataFrame) -> tuple[int, dict[int, list[tuple[int, float, float]]]]:
    """Number of rows, and for each of the most usual lengths (LENGTHS of them) its most variable components: place, mean and
    deviation."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                x = _of(b"".join(b.column(1).filter(pa.array(dims == d)).to_pylist()), np.float64, d) if d else np.zeros((int((dims == 0).sum()), 0))
                new = np.stack([np.full(d + 1, float(len(x))), np.append(x.sum(0), 0), np.append((x * x).sum(0), 0)])
                sums[d] = sums[d] + new if d in sums else new
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d), pa.int32()), pa.array(np.arange(d + 1), pa.int32()), *map(pa.array, s)], names=["dim", "i", "n", "s", "ss"])

    each = rows.select("dim", "q").mapInArrow(run, "dim int, i int, n double, s double, ss double").groupBy("dim", "i").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    mean = F.col("s") / F.col("n")
    spread = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))
    best = F.slice(F.sort_array(F.collect_list(F.when(F.col("i") < F.col("dim"), F.struct(spread.alias("v"), "i", mean.alias("m")))), False), 1, CURVE)
    got = checkpointed(each.groupBy("dim").agg(F.max("n").cast("long").alias("n"), best.alias("best")))
    total = got.agg(F.sum("n")).first()[0] or 0
    return total, {r.dim: [(x.i, x.m, x.v**0.5) for x in r.best] for r in got.orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}


_ROW = "kind int, unit bigint, block bigint, dim int, low_id bigint, ids binary, labels binary, vecs binary, lo binary, hi binary"


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks (kind 0), packs of anchors (1; unit is the bundle that most of them are in) and bundles' zone maps (2), written as
    Parquet in the order of the curve and read back."""
    spark = rows.sparkSession
    n, grid = grids(rows)

    def place(batches):
        for b in batches:
            dims, h = b.column(3).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d, best in grid.items():
                at = np.flatnonzero(dims == d)
                if not len(at) or not best:
                    continue
                x = _of(b"".join(b.column(4).take(pa.array(at)).to_pylist()), np.float64, d)[:, [i for i, _, _ in best]]
                mean, dev = np.array([m for _, m, _ in best]), np.array([s or 1.0 for _, _, s in best])
                half = 1 << (CURVE_BITS - 1)
                h[at] = hilbert(np.clip(np.nan_to_num((x - mean) / dev, nan=0.0) * (half / 2) + half, 0, 2 * half - 1).astype(np.int64), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(3), b.column(4), pa.array(h)], names=["id", "label", "anchor", "dim", "q", "h"])

    def cut(batches):
        part, names = TaskContext.get().partitionId(), [x.split()[0] for x in _ROW.split(", ")]
        made, packs, block, dim, zones = 0, 0, [], None, []
        waiting: list[tuple] = []

        def row(kind, unit, number, ids, labels, x, lo, hi):
            cells = [[kind], [unit], [number], [dim], [int(ids.min()) if len(ids) else 0], *([np.ascontiguousarray(c).tobytes()] for c in (ids, labels, x, lo, hi))]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)

        def unit():
            return (part << 32) | (made // BUNDLE)

        def pack():
            nonlocal packs
            packs += 1
            none = np.zeros(0)
            return row(1, waiting[0][3], (part << 32) | packs, *(np.concatenate([w[i] for w in waiting]) for i in range(3)), none, none)

        def bundle():
            low = np.array([z[2] for z in zones])
            none = np.zeros(0)
            return row(2, unit(), 0, low, none, none, np.min([z[0] for z in zones], axis=0), np.max([z[1] for z in zones], axis=0))

        def close(last):
            """The block so far; the pack and the bundle too, if they are full or end here."""
            nonlocal made, block, zones, waiting
            ids, labels, anchor = (np.concatenate([r[i] for r in block]) for i in range(3))
            x = np.concatenate([r[3] for r in block])
            lo, hi = x.min(0), x.max(0)
            yield row(0, unit(), (part << 32) | made, ids, labels, x, lo, hi)
            zones.append((lo, hi, ids.min()))
            if anchor.any():
                waiting.append((ids[anchor], labels[anchor], x[anchor], unit()))
            if waiting and (last or (made + 1) % BUNDLE == 0 or sum(len(w[0]) for w in waiting) >= PACK):
                yield pack()
                waiting = []
            if last or (made + 1) % BUNDLE == 0:
                yield bundle()
                zones = []
                made += -(made + 1) % BUNDLE
            made, block = made + 1, []

        def end():
            """What is open, before vectors of another length or no more."""
            nonlocal made, zones, waiting
            if block:
                yield from close(True)
            elif zones:
                if waiting:
                    yield pack()
                yield bundle()
                zones, waiting = [], []
                made += -made % BUNDLE

        size = 0
        for b in batches:
            ids, labels, anchor, dims = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            at = 0
            while at < b.num_rows:
                if dims[at] != dim:
                    yield from end()
                    size, dim = 0, int(dims[at])
                to = at + min(int(np.argmin(np.append(dims[at:] == dim, False))), BLOCK - size)
                x = _of(b"".join(b.column(4).slice(at, to - at).to_pylist()), np.float64, dim) if dim else np.zeros((to - at, 0))
                block.append((ids[at:to], labels[at:to], anchor[at:to], x))
                size, at = size + to - at, to
                if size == BLOCK:
                    yield from close(False)
                    size = 0
        yield from end()

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), n // (BLOCK * BUNDLE))
    order = ["dim", "h", "id"]
    placed = rows.mapInArrow(place, "id bigint, label bigint, anchor boolean, dim int, q binary, h bigint")
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "label", "anchor", "dim", "q")
    dealt.mapInArrow(cut, _ROW).write.parquet(at := folder(spark))
    return spark.read.schema(_ROW).parquet(at)


def bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of x with any vector between lo and hi, a row of each a zone: exact up to
    2**53, with a margin for rounding beyond."""
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    most, least = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
    far = abs(x) @ np.maximum(abs(lo), abs(hi)).T
    margin = np.where(far < 2**53, 0, 1e-9 * far)
    return least - margin, most + margin


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers: exact in floats up to 2**53, else by integers of any size."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if float(abs(x).max()) * float(abs(y).max()) * x.shape[1] < 2**53:
        return (x @ y.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object)
    return np.array((whole(x) @ whole(y).T).tolist(), np.int64)  # OverflowError beyond 64 bits


class Windows:
    """Searches of some anchors: lo and hi (anchor, window), and the best so far, score and id (anchor, window, place); a place
    without a row has the least score and the greatest id."""

    def __init__(self, dim: int, kind: tuple[int, int, bool], *cells: bytes):
        w, k, self.same = kind
        ids, labels, x, lo, hi, s, i = cells
        self.kind, self.ids, self.labels, self.lo, self.hi = kind, _of(ids), _of(labels), _of(lo, width=w), _of(hi, width=w)
        self.x = _of(x, np.float64, dim) if dim else np.zeros((len(self.ids), 0))
        self.score, self.id = _of(s).reshape(-1, w, k).copy(), _of(i).reshape(-1, w, k).copy()
        self.fresh = np.zeros(self.id.shape, bool)

    def cells(self, at=slice(None)) -> list[bytes]:
        return [np.ascontiguousarray(c[at]).tobytes() for c in (self.ids, self.labels, self.x, self.lo, self.hi, self.score, self.id)]

    def needed(self, lo: np.ndarray, hi: np.ndarray, low_id: np.ndarray) -> np.ndarray:
        """(anchor, zone): whether a row of the zone may enter a window."""
        least, most = bounds(self.x, lo, hi)
        out = np.zeros(least.shape, bool)
        for w in range(self.kind[0]):
            worst, last = self.score[:, w, -1, None], self.id[:, w, -1, None]
            open_ = self.lo[:, w, None] <= self.hi[:, w, None]
            better = (most > worst) | ((most == worst) & (low_id[None, :] < last))
            out |= open_ & better & (most >= self.lo[:, w, None]) & (least <= self.hi[:, w, None])
        return out

    def take(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Rows (score: anchor of at, row) that may be partners of the anchors at."""
        partner = ((self.labels[at][:, None] == labels[None, :]) == self.same) & (self.ids[at][:, None] != ids[None, :])
        for w in range(self.kind[0]):
            fit = partner & (score >= self.lo[at, w, None]) & (score <= self.hi[at, w, None]) & ((score > self.score[at, w, -1, None]) | ((score == self.score[at, w, -1, None]) & (ids[None, :] < self.id[at, w, -1, None])))
            for n in np.flatnonzero(fit.any(1)).tolist():
                on = np.flatnonzero(fit[n])
                self.put(int(at[n]), w, score[n, on], ids[on])

    def put(self, n: int, w: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[n, w], score]), np.concatenate([self.id[n, w], ids])
        first = np.lexsort((i, ~s))[: self.kind[1]]  # ~ reverses without overflow
        self.score[n, w], self.id[n, w] = s[first], i[first]
        self.fresh[n, w] = np.concatenate([self.fresh[n, w], np.ones(len(ids), bool)])[first]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors whose windows hold rows put since, and scores and ids of those."""
        at = np.flatnonzero(self.fresh.any((1, 2)))
        return at, np.where(self.fresh, self.score, _LEAST)[at], np.where(self.fresh, self.id, _MOST)[at]


_STATE = "pack bigint, unit bigint, dim int, ids binary, labels binary, vecs binary, lo binary, hi binary, score binary, id binary"
_BACK = "pack bigint, who binary, score binary, id binary"


def _batch(ddl: str, *cells) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([c], kinds[f.split()[1]]) for c, f in zip(cells, ddl.split(", "), strict=True)], names=[f.split()[0] for f in ddl.split(", ")])


def _each(batches):
    """Rows as tuples."""
    for b in batches:
        for n in range(b.num_rows):
            yield tuple(c[n].as_py() for c in b.columns)


def _searched(state: DataFrame, stored: DataFrame, sent: DataFrame, kind: tuple[int, int, bool]) -> DataFrame:
    """state with what the sent anchors find in their bundles."""
    null = lambda t: F.lit(None).cast(t)
    held = stored.where("kind = 0").select("unit", F.lit(0).alias("kind"), F.col("block").alias("pack"), "dim", null("binary").alias("who"), "low_id", "ids", "labels", "vecs", "lo", "hi", null("binary").alias("score"), null("binary").alias("id"))
    held = held.join(sent.select(F.col("unit").alias("_u")).distinct().hint("merge"), F.col("unit") == F.col("_u"), "left_semi")

    def find(batches):
        now, parts, zones = None, [], None
        for unit, k, pack, dim, who, low_id, ids, labels, vecs, lo, hi, s, i in _each(batches):
            if unit != now:
                now, parts, zones = unit, [], None
            if k == 0:
                x = _of(vecs, np.float64, dim) if dim else np.zeros((len(ids) // 8, 0))
                parts.append((_of(lo, np.float64), _of(hi, np.float64), low_id, _of(ids), _of(labels), x))
                continue
            if zones is None:
                zones = np.stack([p[0] for p in parts]), np.stack([p[1] for p in parts]), np.array([p[2] for p in parts])
            q = Windows(dim, kind, ids, labels, vecs, lo, hi, s, i)
            most = bounds(q.x, zones[0], zones[1])[1].max(0)
            for b in np.argsort(-most).tolist():  # what windows hold by now decides whether the next block is read
                at = np.flatnonzero(q.needed(zones[0][b : b + 1], zones[1][b : b + 1], zones[2][b : b + 1])[:, 0])
                if len(at):
                    q.take(at, scores(q.x[at], parts[b][5]), parts[b][3], parts[b][4])
            new, score, id_ = q.found()
            if len(new):
                yield _batch(_BACK, pack, _of(who, np.int32)[new].tobytes(), score.tobytes(), id_.tobytes())

    found = held.unionByName(sent).repartition("unit").sortWithinPartitions("unit", "kind", "pack").mapInArrow(find, _BACK)
    w, k, _ = kind

    def merge(batches):
        q, head = None, None
        for row in _each(batches):
            if row[1] == 0:
                if q is not None:
                    yield _batch(_STATE, *head, *q.cells())
                head, q = (row[0], row[3], row[4]), Windows(row[4], kind, *row[5:12])
                continue
            who, s, i = _of(row[2], np.int32), _of(row[10]).reshape(-1, w, k), _of(row[11]).reshape(-1, w, k)
            for n, a in enumerate(who.tolist()):
                for v in range(w):
                    q.put(a, v, s[n, v], i[n, v])
        if q is not None:
            yield _batch(_STATE, *head, *q.cells())

    none = null("binary")
    first = state.select("pack", F.lit(0).alias("kind"), none.alias("who"), "unit", "dim", "ids", "labels", "vecs", "lo", "hi", "score", "id")
    rest = found.select("pack", F.lit(1).alias("kind"), "who", null("bigint").alias("unit"), null("int").alias("dim"), *(none.alias(c) for c in ("ids", "labels", "vecs", "lo", "hi")), "score", "id")
    return checkpointed(first.unionByName(rest).repartition("pack").sortWithinPartitions("pack", "kind").mapInArrow(merge, _STATE))


def search(stored: DataFrame, state: DataFrame, kind: tuple[int, int, bool]) -> DataFrame:
    """state with the best rows of all windows: first from each pack's own bundle, then from all whose zone maps allow it."""
    who = F.lit(None).cast("binary")

    def send(df: DataFrame) -> DataFrame:
        return df.select("unit", F.lit(1).alias("kind"), "pack", "dim", "who", F.lit(0).cast("bigint").alias("low_id"), "ids", "labels", "vecs", "lo", "hi", "score", "id")

    def everyone(batches):
        for b in batches:
            made = [np.arange(len(x) // 8, dtype=np.int32).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], names=b.schema.names)

    own = state.select("*", who.alias("who")).mapInArrow(everyone, f"{_STATE}, who binary")
    state = _searched(state, stored, send(own), kind)
    zones = checkpointed(stored.where("kind = 2").select("unit", "dim", "low_id", "lo", "hi"))
    pages = max(1, -(-zones.count() // PAGE))

    def page(table: pa.Table) -> pa.Table:
        join = lambda c: b"".join(table[c].to_pylist())
        return pa.table([pa.array([table["dim"][0].as_py()], pa.int32()), pa.array([table["page"][0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in (np.array(table["unit"].to_pylist(), np.int64).tobytes(), np.array(table["low_id"].to_pylist(), np.int64).tobytes(), join("lo"), join("hi")))], names=["pdim", "ppage", "units", "low_ids", "los", "his"])

    paged = zones.withColumn("page", F.pmod(F.xxhash64("unit"), F.lit(pages)).cast("int")).groupBy("dim", "page").applyInArrow(page, "pdim int, ppage int, units binary, low_ids binary, los binary, his binary")
    every = state.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    both = every.join(paged.hint("merge"), (F.col("dim") == F.col("pdim")) & (F.col("page") == F.col("ppage")))

    def choose(batches):
        for pack, unit, dim, *cells, units, low_ids, los, his in _each(batches):
            q, units = Windows(dim, kind, *cells), _of(units)
            lo, hi = (_of(z, np.float64, dim) if dim else np.zeros((len(units), 0)) for z in (los, his))
            need = q.needed(lo, hi, _of(low_ids))
            for n in np.flatnonzero(need.any(0) & (units != unit)).tolist():
                at = np.flatnonzero(need[:, n])
                yield _batch(f"{_STATE}, who binary", pack, int(units[n]), dim, *q.cells(at), at.astype(np.int32).tobytes())

    fields = [f.split()[0] for f in _STATE.split(", ")]
    chosen = checkpointed(both.select(*fields, "units", "low_ids", "los", "his").mapInArrow(choose, f"{_STATE}, who binary"))
    return _searched(state, stored, send(chosen), kind)


def _opened(packs: DataFrame, positives: int) -> DataFrame:
    """Packs with one open window an anchor for its positives."""

    def run(batches):
        for unit, pack, dim, ids, labels, vecs in _each(batches):
            n = len(ids) // 8
            yield _batch(_STATE, pack, unit, dim, ids, labels, vecs, np.full(n, _LEAST).tobytes(), np.full(n, _MOST).tobytes(), np.full(n * positives, _LEAST).tobytes(), np.full(n * positives, _MOST).tobytes())

    return packs.select("unit", F.col("block").alias("pack"), "dim", "ids", "labels", "vecs").mapInArrow(run, _STATE)


def _narrowed(state: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """For each positive a window of scores with low * positive <= 100 * score <= high * positive; pid and pscore keep what
    they are of. Places without a positive have a window that is empty."""

    def run(batches):
        for pack, unit, dim, ids, labels, vecs, _, _, score, id_ in _each(batches):
            s, i = _of(score), _of(id_)
            lo = np.array([-(-low * x // 100) if k != _MOST or x != _LEAST else 1 for x, k in zip(s.tolist(), i.tolist(), strict=True)], np.int64)
            hi = np.array([high * x // 100 if k != _MOST or x != _LEAST else 0 for x, k in zip(s.tolist(), i.tolist(), strict=True)], np.int64)
            yield _batch(f"{_STATE}, pid binary, pscore binary", pack, unit, dim, ids, labels, vecs, lo.tobytes(), hi.tobytes(), np.full(len(s) * negatives, _LEAST).tobytes(), np.full(len(s) * negatives, _MOST).tobytes(), id_, score)

    return checkpointed(state.mapInArrow(run, f"{_STATE}, pid binary, pscore binary"))


def hard_negatives(df: DataFrame, anchor: Column, key: str = "vec_id", vec: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best
    positives, the best rows of other labels whose score is from low to high percent of the positive's."""
    stored = blocks(vectors(df, key, vec, label, anchor, scale))
    found = search(stored, checkpointed(_opened(stored.where("kind = 1"), positives)), (1, positives, True))
    asked = _narrowed(found, positives, negatives, low, high)
    got = search(stored, asked.drop("pid", "pscore"), (positives, negatives, False))
    both = got.select("pack", "ids", "score", "id").join(asked.select(F.col("pack").alias("_p"), "pid", "pscore").hint("merge"), F.col("pack") == F.col("_p"))

    def run(batches):
        for ids, score, id_, pid, pscore in _each(batches):
            s, i = _of(score).reshape(-1, positives, negatives), _of(id_).reshape(-1, positives, negatives)
            p, ps, a = _of(pid, width=positives), _of(pscore, width=positives), _of(ids)
            n, w, r = np.nonzero((i != _MOST) | (s != _LEAST))
            yield pa.RecordBatch.from_arrays([pa.array(a[n]), pa.array(p[n, w]), pa.array(r + 1, pa.int32()), pa.array(i[n, w, r]), pa.array(ps[n, w]), pa.array(s[n, w, r])], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return both.select("ids", "score", "id", "pid", "pscore").mapInArrow(run, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df.withColumn("label", noisy), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) x WHERE n <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id AS anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id) AS rank, s.id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) y WHERE rank <= 3
"""
