"""MinHash near-dedup by an LSH forest.

A document's set is its distinct word shingles, each by a 64-bit hash. ``TREES`` sorted orders of ``DEPTH``-value
MinHash labels make the forest; documents whose labels share ``LEAST`` values are in one region of a tree.

* Documents with equal sets (by a 128-bit BLAKE2 digest of the whole sorted set) are one class, named by its smallest id;
  hot groups of copies are one row from here on.
* First, in ``CHAINS`` trees, label neighbours (by longest common prefix) are candidates: at most one pair a row, so
  that large groups become connected without pairing all members.
* Then, in all trees, classes that share a region but no component are candidates: those outside a region's main
  component against the region. A region with more than ``FEW`` such pairs is closed exactly
  instead: first all its members against its most usual one; then they are sorted by their own shingles, rare ones first,
  and only pairs of two components that share a shingle near enough to the front of both are candidates, so none that
  could be confirmed is dropped.
* Candidates are confirmed on full sets. Tasks first contract their own links, LINKS at a time; components come from min-label
  rounds with pointer jumps over what is left.

Null and wordless texts have no set and link with nothing. Rows of one id are one document: where their texts differ,
the one of the least hash (of those with words) makes its links, and all have its component. Rows keep their number; a
null id is a document of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shards import checkpointed
from ._text import LOWER, columns, grams, hash_spans, inside, lut, mix, pieces, spans

TREES, DEPTH, LEAST, CHAINS, FEW = 24, 6, 4, 6, 4096
MEMBERS, BUCKET_SETS = 128, 2048
#: Links that a task contracts at a time.
LINKS = 1 << 16
_RNG = np.random.Generator(np.random.PCG64(20))
_MUL = _RNG.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each begins."""
    data = LOWER[data]
    starts, ends, firsts = spans(data, offs, lut("space"))
    h = hash_spans(data, starts, ends)
    n = np.diff(firsts)
    ok = inside(firsts, len(h), k)
    at = np.flatnonzero(ok)
    out, row = grams(h, k)[at], np.searchsorted(firsts, at, "right") - 1
    if len(short := np.flatnonzero((n > 0) & (n < k))):  # the whole sequence as one
        whole = [grams(h[firsts[r] : firsts[r + 1]], int(n[r]))[0] ^ np.uint64(n[r]) for r in short]
        out, row = np.concatenate([out, np.array(whole, np.uint64)]), np.concatenate([row, short])
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(offs)))


def _texts(docs: DataFrame, key: str, col: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{col}`").cast("string").alias("text"))


def signatures(docs: DataFrame, key: str, col: str, k: int) -> DataFrame:
    """id, th (hash of the text), n (size of the set), d1 and d2 (digest of the set), sig (labels of all trees; null for
    empty sets)."""

    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            h, firsts = sets(*columns(b, "text"), k)
            n = np.diff(firsts)
            full = np.flatnonzero(n)
            sig, digest = np.zeros((len(full), TREES * DEPTH), ">u4"), np.zeros((b.num_rows, 2), np.int64)
            if len(full):
                at = firsts[:-1][full]
                made = b"".join(hashlib.blake2b(h[x:y].data, digest_size=16).digest() for x, y in zip(at.tolist(), firsts[1:][full].tolist(), strict=True))
                digest[full] = np.frombuffer(made, np.int64).reshape(-1, 2)
                for j in range(TREES * DEPTH):
                    sig[:, j] = np.minimum.reduceat((h * _MUL[j] + _ADD[j]) >> np.uint64(32), at)
            out = [None] * b.num_rows
            for r, s in zip(full.tolist(), sig, strict=True):
                out[r] = s.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(out, pa.binary())], names=["id", "th", "n", "d1", "d2", "sig"])

    return _texts(docs, key, col).select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "id bigint, th bigint, n bigint, d1 bigint, d2 bigint, sig binary")


def shared_regions(classes: DataFrame) -> DataFrame:
    """rep, tree, region (tree and first LEAST values, hashed) and label (the other values, in sorting form) of classes
    that are not alone in the region."""
    labels = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * (4 * DEPTH) + F.lit(1), F.lit(4 * LEAST)).alias("first"), F.substring("sig", t * (4 * DEPTH) + F.lit(4 * LEAST + 1), F.lit(4 * (DEPTH - LEAST))).alias("label")))
    rows = classes.select("rep", F.explode(labels).alias("x")).select("rep", "x.tree", F.xxhash64("x.tree", "x.first").alias("region"), "x.label")
    often = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("region").alias("_g"), F.xxhash64("region").alias("_k"))
    left = rows.withColumn("_l", F.xxhash64("region"))
    return left.join(often.hint("merge"), (left["_l"] == often["_k"]) & (left["region"] == often["_g"])).select("rep", "tree", "region", "label")


def chain_candidates(rows: DataFrame) -> DataFrame:
    """Neighbours in the sorted orders that share a region. Partitions' edges meet in a second, small step."""
    names = ["kind", "a", "b", "region"]

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, region = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is None:
                yield pa.RecordBatch.from_arrays([pa.array([2 * part + 1]), pa.array([rep[0]]), pa.array([rep[0]]), pa.array([region[0]])], names=names)
            elif last[1] == region[0]:
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([last[0]]), pa.array([rep[0]]), pa.array([region[0]])], names=names)
            at = np.flatnonzero(region[1:] == region[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1)), pa.array(rep[at]), pa.array(rep[at + 1]), pa.array(region[at])], names=names)
            last = rep[-1], region[-1]
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([2 * part + 2]), pa.array([last[0]]), pa.array([last[0]]), pa.array([last[1]])], names=names)

    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = checkpointed(rows.repartitionByRange(parts, "region", "label", "rep").sortWithinPartitions("region", "label", "rep").select("rep", "region").mapInArrow(run, "kind bigint, a bigint, b bigint, region bigint"))
    edges = found.where("kind >= 0")  # two rows a partition
    from pyspark.sql import Window

    over = edges.withColumns({"r2": F.lead("region").over(Window.partitionBy(F.lit(0)).orderBy("kind")), "b2": F.lead("a").over(Window.partitionBy(F.lit(0)).orderBy("kind")), "k2": F.lead("kind").over(Window.partitionBy(F.lit(0)).orderBy("kind"))})
    met = over.where((F.col("kind") % 2 == 0) & (F.col("r2") == F.col("region"))).select("a", F.col("b2").alias("b"))
    both = found.where("kind < 0").select("a", "b").union(met).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _main(rows: DataFrame, by: str, having: str) -> DataFrame:
    """rows (with comp) with rows, minor and main, by group: its rows, those outside its largest component, and that
    component; groups that fail having go.

    The join has a key of its own, so that both sides are dealt anew and a hot group can be split."""
    sizes = rows.groupBy(by, "comp").agg(F.count(F.lit(1)).alias("m"))
    groups = sizes.groupBy(by).agg(F.max(F.struct("m", "comp")).alias("x"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("comps"))
    groups = groups.where(having).select(F.col(by).alias("_g"), F.col("x.comp").alias("main"), F.col("n").alias("rows"), (F.col("n") - F.col("x.m")).alias("minor"), F.xxhash64(by).alias("_k"))
    left = rows.withColumn("_l", F.xxhash64(by))
    return left.join(groups.hint("merge"), (left["_l"] == groups["_k"]) & (left[by] == groups["_g"])).drop("_l", "_k", "_g")


def _with(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows (rep, ...) with their component, so far."""
    return rows.join(comps.hint("merge"), rows["rep"] == comps["id"], "left").drop("id").withColumn("comp", F.coalesce("comp", "rep"))


def packed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, z: the compressed texts of the ids (rep)."""
    texts = texts.join(ids.hint("merge"), texts["id"] == ids["rep"], "left_semi")

    def squeeze(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zstandard.compress((t.as_py() or "").encode(), 3) for t in b.column(1)], pa.binary())], names=["id", "z"])

    return texts.mapInArrow(squeeze, "id bigint, z binary").groupBy("id").agg(F.min("z").alias("z"))


def _unpacked(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    raws = [zstandard.decompress(x.as_py()) for x in column]
    return sets(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raws])]).astype(np.int64), k)


def rare_first(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """rep, n, usual (mean count of its shingles among members) and front: place and hash of those of its first shingles
    (rare among members first) that others have too. Sets go to buckets of shingles and back in packs of MEMBERS sets; a
    pack counts its own shingles first, so that a shingle comes to its bucket once a pack."""
    some = checkpointed(texts.join(members.select("rep").distinct().hint("merge"), texts["id"] == F.col("rep"), "left_semi").select("id", "z"))
    buckets = max(1, -(-some.count() // BUCKET_SETS))
    row = "pack bigint, bucket int, reps binary, t binary, n binary, at binary, of binary, df binary"
    names = [x.split()[0] for x in row.split(", ")]

    def send(batches):
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, MEMBERS):
                part = b.slice(at, MEMBERS)
                h, firsts = _unpacked(part.column(1), k)
                of = np.repeat(np.arange(part.num_rows, dtype="<u4"), np.diff(firsts))
                bucket = (mix(h) >> np.uint64(33)) % np.uint64(buckets)
                reps = part.column(0).to_numpy().astype("<i8").tobytes()
                for k_ in np.unique(bucket):
                    on = bucket == k_
                    t, at_, n = np.unique(h[on], return_inverse=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([int(k_)], pa.int32()), *(pa.array([x]) for x in (reps, t.tobytes(), n.astype("<u4").tobytes(), at_.astype("<u4").tobytes(), of[on].tobytes())), pa.array([None], pa.binary())], names=names)
                made += 1

    def count(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, "<u8") for x in table["t"].to_pylist()]
        _, of = np.unique(np.concatenate(sent), return_inverse=True)
        n = np.bincount(of, np.concatenate([np.frombuffer(x, "<u4") for x in table["n"].to_pylist()]))
        cut = np.cumsum([0, *map(len, sent)])
        df = n[of].astype("<u4")
        return table.set_column(7, "df", pa.array([df[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))

    def order(table: pa.Table) -> pa.Table:
        places = [np.frombuffer(x, "<u4") for x in table["at"].to_pylist()]
        t, df = (np.concatenate([np.frombuffer(x, kind)[at] for x, at in zip(table[name].to_pylist(), places, strict=True)]) for name, kind in (("t", "<i8"), ("df", "<u4")))
        of = np.concatenate([np.frombuffer(x, "<u4") for x in table["of"].to_pylist()])
        reps = np.frombuffer(table["reps"][0].as_py(), "<i8")
        o = np.lexsort((t, df, of))
        t, df = t[o], df[o]
        cut = np.searchsorted(of[o], np.arange(len(reps) + 1))
        out = []
        for r in range(len(reps)):
            n = int(cut[r + 1] - cut[r])
            front = np.arange(cut[r], cut[r] + n - -(-n * percent // 100) + 1 if n else cut[r])
            front = front[df[front] > 1]
            out.append((int(reps[r]), n, float(df[cut[r] : cut[r + 1]].mean()) if n else 0.0, [{"i": int(i - cut[r]), "t": int(t[i])} for i in front]))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("i", pa.int64()), ("t", pa.int64())])))
        return pa.table([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=["rep", "n", "usual", "front"])

    counted = some.mapInArrow(send, row).groupBy("bucket").applyInArrow(count, row)
    return counted.groupBy("pack").applyInArrow(order, "rep bigint, n bigint, usual double, front array<struct<i:bigint,t:bigint>>")


def front_candidates(ordered: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Every pair of ordered sets, of two components, that can reach the similarity.

    Two sets that reach it share a shingle among the first of both, so near enough to the front that what follows can
    still be enough; only pairs with such a shingle are made."""
    back = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    placed = _with(ordered.select("rep", "n", "front"), comps).select("rep", "comp", "n", back.alias("back"), F.explode("front").alias("x")).select("rep", "comp", "n", "back", "x.i", "x.t")
    found = checkpointed(_main(placed, "t", "comps > 1"))
    names = ("rep", "comp", "n", "i", "t", "main")
    small = found.where("i < back").select(*(F.col(c).alias(f"{c}1") for c in names))
    other = found.select(*(F.col(c).alias(f"{c}2") for c in names))
    enough = (F.col("t1") == F.col("t2")) & (F.col("comp1") != F.col("comp2")) & (F.struct("n1", "rep1") < F.struct("n2", "rep2")) & (F.col("n1") * 100 >= F.col("n2") * percent) & (F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2")) * (100 + percent) >= percent * (F.col("n1") + F.col("n2")))
    a = small.where("comp1 <> main1").join(other.hint("merge"), enough)
    b = small.where("comp1 = main1").join(other.where("comp2 <> main2").hint("merge"), enough)
    return a.select("rep1", "rep2").union(b.select("rep1", "rep2")).select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sets have 100 * intersection >= percent * union."""
    side = pairs.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")).hint("merge"), "b")
    side = side.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")).hint("merge"), "a").select("a", "b", "za", "zb")

    def run(batches):
        held, mine = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                yes = []
                h, firsts = _unpacked(b.column(3), k)
                for i, a in enumerate(b.column(0).to_pylist()):
                    if a != held:
                        held, mine = a, _unpacked(b.column(2).slice(i, 1), k)[0]
                    x = h[firsts[i] : firsts[i + 1]]
                    at = np.searchsorted(mine, x)
                    both = int((mine[np.minimum(at, max(0, len(mine) - 1))] == x).sum()) if len(mine) else 0
                    yes.append(bool(len(x)) and 100 * both >= percent * (len(mine) + len(x) - both))
                at = pa.array(np.flatnonzero(yes))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return checkpointed(side.mapInArrow(run, "a bigint, b bigint"))


def _open_pairs(open_: DataFrame) -> DataFrame:
    """Pairs of two components in each region, one of them not the region's main."""
    less = open_.where(F.col("comp") != F.col("main")).select(F.col("rep").alias("a"), F.col("region").alias("ra"), F.col("comp").alias("ca"))
    every = open_.select(F.col("rep").alias("b"), F.col("region").alias("rb"), F.col("comp").alias("cb"))
    return less.join(every.hint("merge"), (F.col("ra") == F.col("rb")) & (F.col("ca") != F.col("cb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked(classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """id, comp of the classes (rep) that have links. docs: id, text."""
    rows = checkpointed(shared_regions(classes))
    texts = checkpointed(packed(docs, rows.select("rep").distinct()))
    comps = components(confirmed(chain_candidates(rows.where(F.col("tree") < CHAINS)), texts, k, percent))

    def grown(pairs: DataFrame) -> DataFrame:
        found = confirmed(pairs, texts, k, percent)
        return comps if found.isEmpty() else components(found, comps)

    open_ = checkpointed(_main(_with(rows.select("rep", "region"), comps), "region", "comps > 1"))
    few = F.col("rows") * F.col("minor") <= FEW
    pairs = _open_pairs(open_.where(few))
    dense = checkpointed(open_.where(~few).select("rep", "region"))
    if dense.isEmpty():
        return grown(pairs.distinct())
    # each dense region's most usual member is a candidate for all others, which leaves few open pairs to the exact filter
    ordered = checkpointed(rare_first(dense, texts, k, percent))
    usual = dense.join(ordered.select(F.col("rep").alias("_r"), "usual").hint("merge"), F.col("rep") == F.col("_r"))
    hubs = usual.groupBy("region").agg(F.max(F.struct("usual", "rep")).alias("x")).select(F.col("region").alias("_g"), F.col("x.rep").alias("hub"), F.xxhash64("region").alias("_k"))
    left = dense.withColumn("_l", F.xxhash64("region"))
    stars = left.join(hubs.hint("merge"), (F.col("_l") == F.col("_k")) & (F.col("region") == F.col("_g")) & (F.col("rep") != F.col("hub"))).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    comps = grown(pairs.union(stars).distinct())
    return grown(front_candidates(ordered, comps, percent))


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of links, and the least id that each reaches by them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        for to, of in ((x, y), (y, x), (root[x], y), (root[y], x)):
            np.minimum.at(low, to, root[of])
        while not np.array_equal(far := low[low], low):
            low = far
        if np.array_equal(low, root):
            return ids, ids[root]
        root = low


def _contracted(links: DataFrame) -> DataFrame:
    """a, b: links that connect what links (a, b) do. Every LINKS of them at most become one of each id to the least id that they
    lead it to, so that a path is as many steps shorter. The number of tasks follows that of links."""

    def run(batches):
        held, n = [], 0

        def flush():
            ids, least = _least(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            at = np.flatnonzero(ids != least)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(least[at])], names=["a", "b"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= LINKS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return links.coalesce(max(2, -(-links.count() // LINKS))).mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """id, comp (least id reachable) of every linked id. start: components so far, as more links."""
    links = links.select("a", "b")
    if start is not None:
        links = links.union(start.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")))
    links = _contracted(links)
    links = checkpointed(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b").distinct())
    now = links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    now = checkpointed(now)
    while True:
        seen = links.join(now.hint("merge"), links["b"] == now["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        # what is near an id is near what stands for it, too: whole trees are hooked, not their leaves alone
        both = now.join(seen.hint("merge"), now["id"] == seen["a"]).select(F.explode(F.array(F.struct("id", "comp", F.least("comp", "near").alias("low")), F.struct(F.col("comp").alias("id"), F.lit(None).cast("long").alias("comp"), F.col("near").alias("low")))).alias("x"))
        low = both.select("x.*").groupBy("id").agg(F.max("comp").alias("comp"), F.min("low").alias("low"))
        low = checkpointed(low)
        far = low.select(F.col("id").alias("j"), F.col("low").alias("jump"))
        new = checkpointed(low.join(far.hint("merge"), low["low"] == far["j"]).select("id", F.col("jump").alias("comp"), (F.col("jump") != low["comp"]).alias("moved")))
        now = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return now


def near_dedup(docs: DataFrame, key: str = "doc_id", col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each of docs': key, n_shingles, component_id and kept."""
    base, texts = checkpointed(signatures(docs, key, col, k)), _texts(docs, key, col)
    # ids with several texts: the text that makes the links
    first = F.min(F.struct((F.col("n") == 0).alias("e"), "th"))["th"]
    several = checkpointed(base.where("id is not null").groupBy("id").agg(first.alias("keep"), F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").select(F.col("id").alias("_id"), "keep"))
    some, others = base, None
    if not several.isEmpty():
        both = base.join(several.hint("merge"), base["id"] == several["_id"], "left")
        some, others = both.where("keep is null or th = keep").drop("_id", "keep"), both.where("th <> keep").select("id", "n")
        texts = texts.join(several.hint("merge"), texts["id"] == several["_id"], "left").where(F.col("keep").isNull() | (F.xxhash64("text") == F.col("keep"))).select("id", "text")
    grouped = some.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("sig").alias("sig"))
    classes = checkpointed(grouped)
    comps = linked(classes, texts, k, percent)
    named = classes.join(comps.hint("merge"), classes["rep"] == comps["id"], "left").where("comp is not null or last > rep")
    named = named.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("comp", "rep").alias("comp"))
    left = some.where("n > 0").select("id", "n", "d1", "d2")
    out = left.join(named.hint("merge"), (left["d1"] == named["e1"]) & (left["d2"] == named["e2"]), "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("comp"))
    out = out.unionByName(some.where("n = 0").select("id", "n", F.col("id").alias("comp")))
    if others is not None:
        out = checkpointed(out)
        of = out.join(several.hint("merge"), out["id"] == several["_id"], "left_semi").select(F.col("id").alias("_i"), "comp").distinct()
        out = out.unionByName(others.join(of.hint("merge"), others["id"] == of["_i"]).select("id", "n", "comp"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
