"""SimHash near-dedup by popcounts of segments.

A document's fingerprint has a bit where over half its word shingles' hashes have it. Cut into ``SEGMENTS`` segments, a
fingerprint has a bit count for each; two fingerprints whose counts differ by d in sum (Manhattan distance) differ in d bits
at least. So fingerprints that link are within ``REACH`` of each other on the grid of counts.

* Fingerprints are grouped first: any number of copies is one row from here on.
* Each goes to its own grid cell and to those one step away. Two within two steps meet in a cell: in their own if their counts
  are equal, in that of the smaller if they are one step apart, else half-way.
* A cell compares its fingerprints exactly, in numpy tiles, and returns what its links connect, as one star a group: fewer
  rows than it has fingerprints, however many pairs link. A cell of more than one tile sends its pairs of tiles out as work
  for all tasks instead of comparing them itself.
* Components come from min-label rounds.

Null and wordless texts have fingerprint zero, which links like any other. Every row has its own result: rows of one id are
rows, and a null id takes part but names no component (null where no row of it has an id). Of clashing columns only the
key and the text are read. The empty table has no rows. Texts of any length are hashed in slices.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shards import checkpointed
from ._text import LOWER
from .forest import components

SEGMENTS, REACH, SEED = 16, 2, 42
TILE, SLICE = 4096, 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TABLE = LOWER.tobytes()
_ONES = 0x1111111111111111


def shingle_hashes(text: bytes, k: int):
    """Arrays of the hashes of a text's shingles of k words, repeats included; of all its words if there are fewer."""
    words, out = [], []
    for m in _WORD.finditer(text.translate(_TABLE)):
        words.append(m[0])
        if len(words) >= k:
            out.append(xxhash.xxh64_intdigest(b" ".join(words[-k:]), SEED))
            if len(out) >= SLICE:
                yield np.array(out, np.uint64)
                words, out = words[-k:], []
    if 0 < len(words) < k:
        out.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
    if out:
        yield np.array(out, np.uint64)


def fingerprint(text: bytes, k: int = 3) -> int:
    """The 64-bit fingerprint, unsigned."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", col: str = "text", k: int = 3) -> DataFrame:
    """id and fp (signed) of each row."""

    def run(batches):
        for b in batches:
            made = [fingerprint((t.as_py() or "").encode(), k) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(made, np.uint64).astype(np.int64))], names=["id", "fp"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{col}`").cast("string").alias("text")).mapInArrow(run, "id bigint, fp bigint")


def counts(fp: Column) -> Column:
    """Bit counts of the sixteen segments, a hexadecimal digit each."""
    parts = [F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(_ONES)) for i in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def cells(fps: DataFrame) -> DataFrame:
    """cell, fp: each fingerprint in its own cell and the 32 next to it. A digit is a count and 1."""
    steps = F.array(F.lit(0).cast("long"), *(F.lit(s << 4 * i).cast("long") for i in range(SEGMENTS) for s in (1, -1)))
    return fps.select((counts(F.col("fp")) + F.lit(_ONES)).alias("home"), "fp", F.explode(steps).alias("step")).select((F.col("home") + F.col("step")).alias("cell"), "fp")


def _homes(fp: np.ndarray) -> np.ndarray:
    u, one = fp.view(np.uint64), np.uint64(_ONES)
    return sum((((u >> np.uint64(i)) & one) for i in range(4)), one)


def _tile_links(cell: int, a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of links that this cell is to find."""
    i, j = np.nonzero(np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= bits)
    if not len(i):
        return i, j
    x, y = _homes(a)[i], _homes(b)[j]
    apart = np.zeros(len(i), np.int64)
    for s in range(SEGMENTS):
        of = np.uint64(4 * s)
        apart += np.abs(((x >> of) & np.uint64(15)).astype(np.int64) - ((y >> of) & np.uint64(15)).astype(np.int64))
    least = np.where(a[i] <= b[j], x, y)
    mine = (a[i] != b[j]) & ((apart > 1) | (least == np.uint64(cell)))
    return i[mine], j[mine]


def _stars(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups that links between fp[i] and fp[j] connect, each as links to its first member."""
    to = np.arange(len(fp))
    while True:
        low = np.minimum(to[i], to[j])
        new = to.copy()
        np.minimum.at(new, to[i], low)
        np.minimum.at(new, to[j], low)
        new = new[new]
        if (new == to).all():
            break
        to = new
    at = np.flatnonzero(to != np.arange(len(fp)))
    return fp[to[at]], fp[at]


_FOUND = "a bigint, b bigint, cell bigint, ta binary, tb binary"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), none, none], names=_NAMES)


def _work(cell: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([cell]), pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=_NAMES)


def links(fps: DataFrame, bits: int = REACH, tile: int = TILE) -> DataFrame:
    """a, b: links that connect what all pairs of fps (distinct, column fp) at most bits apart connect."""
    if not 0 <= bits <= REACH:
        raise ValueError(f"bits: 0 to {REACH}")

    def compare(cell, full, last):
        """What a cell's fingerprints give: full tiles and the last, shorter one."""
        if full:
            every = [*full, last] if len(last) else full
            for n, x in enumerate(every):
                for y in every[: n + 1]:
                    yield _work(cell, x, y)
        elif len(last) > 1:
            a, b = _stars(last, *_tile_links(cell, last, last, bits))
            if len(a):
                yield _pairs(a, b)

    def by_cell(batches):
        cell, full, rest = None, [], []
        for batch in batches:
            at, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist() if len(at) else []
            for x, y in zip(cut, [*cut[1:], len(at)], strict=True):
                if cell is not None and at[x] != cell:
                    if full or len(rest) > 1 or len(rest[0]) > 1:
                        yield from compare(cell, full, np.concatenate(rest))
                    full, rest = [], []
                cell = int(at[x])
                rest.append(fp[x:y])
                if sum(map(len, rest)) >= tile:
                    every = np.concatenate(rest)
                    whole = len(every) // tile * tile
                    full += np.split(every[:whole], whole // tile)
                    rest = [every[whole:]]
        if cell is not None:
            yield from compare(cell, full, np.concatenate(rest))

    def worked(batches):
        for batch in batches:
            for cell, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(2, 5)), strict=True):
                a, b = np.frombuffer(ta, np.int64), np.frombuffer(tb, np.int64)
                i, j = _tile_links(cell, a, b, bits)
                x, y = _stars(np.concatenate([a, b]), i, j + len(a))
                if len(x):
                    yield _pairs(x, y)

    found = checkpointed(cells(fps).repartition("cell").sortWithinPartitions("cell").mapInArrow(by_cell, _FOUND))
    work = found.where("cell is not null")
    parts = max(2, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    more = work.repartition(parts, F.xxhash64("cell", "ta", "tb")).mapInArrow(worked, _FOUND)
    return found.where("cell is null").unionByName(more).select("a", "b").where("a <> b").distinct()


def simhash_dedup(docs: DataFrame, key: str = "doc_id", col: str = "text", k: int = 3, bits: int = REACH) -> DataFrame:
    """One row for each of docs': key, fp (signed fingerprint) and component_id (the least id that links reach)."""
    rows = checkpointed(fingerprints(docs, key, col, k))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    comps = components(checkpointed(links(fps.select("fp"), bits)))
    named = fps.join(comps.hint("merge"), fps["fp"] == comps["id"], "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id")).withColumnRenamed("comp", "_c")
    both = named.join(least.hint("merge"), named["comp"] == least["_c"]).select(F.col("fp").alias("_f"), "component_id", F.xxhash64("fp").alias("_k"))
    left = rows.withColumn("_l", F.xxhash64("fp"))
    return left.join(both.hint("merge"), (left["_l"] == both["_k"]) & (left["fp"] == both["_f"])).select(F.col("id").alias(key), "fp", "component_id")


def op12_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
