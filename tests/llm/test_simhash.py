"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from saleslattice.llm import queries
from saleslattice.llm import simhash as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, bits=2):
    """rows: (id, fp). Least id reachable of each row."""
    fps = sorted({f for _, f in rows})
    comp = {f: f for f in fps}

    def root(f):
        while comp[f] != f:
            comp[f] = comp[comp[f]]
            f = comp[f]
        return f

    for i, f in enumerate(fps):
        for g in fps[i + 1 :]:
            if (f ^ g).bit_count() <= bits:
                comp[root(f)] = root(g)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [(i, f, least.get(root(f))) for i, f in rows]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(7, t, i, "x") for i, t in rows], "component_id long, text string, doc_id long, fp string").repartition(parts)
    got = S.simhash_dedup(df)
    assert got.columns == ["doc_id", "fp", "component_id"]
    return sorted(((r[0], r[1] % 2**64, r[2]) for r in got.collect()), key=key)


def test_texts(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, base.replace(f"w{i * 3} ", f"v{i} ")) for i in range(60)] + [(i, "Same  TEXT\there again") for i in range(100, 140)]
    rows += [(200, None), (201, ""), (202, " \x0b\n"), (203, "one"), (204, "one two"), (205, "ONE two"), (206, "a\x1cb é É \xa0"), (None, "one two"), (None, "alone and without id"), (200, "other text of one id"), (5, base), (5, base)]
    rows += [(300, "long " * 200_000), (301, "x" * 3_000_000)]
    assert run(spark, rows) == sorted(plain_components([(i, plain_fingerprint(t)) for i, t in rows]), key=key)


def test_empty(spark):
    assert run(spark, []) == []


def neighbours(n, seed):
    """Chains of fingerprints a few bits apart, and others."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                f ^= 1 << b
    return sorted(out)


def signed(f):
    return f - 2**64 if f >= 2**63 else f


def test_links_connect_what_all_pairs_do(spark):
    fps = neighbours(600, 1) + [0, 2**64 - 1, 1 << 63, 3 << 62, 2**64 - 2]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for bits, tile in ((2, S.TILE), (2, 2), (1, S.TILE), (0, S.TILE)):
        found = [(a % 2**64, b % 2**64) for a, b in S.links(df, bits, tile).collect()]
        comp = {f: f for f in fps}
        for _ in range(len(fps)):
            for a, b in found:
                comp[a] = comp[b] = min(comp[a], comp[b])
            if all(comp[a] == comp[b] for a, b in found):
                break
        want = plain_components([(f, f) for f in fps], bits)
        assert [(f, comp[f]) for f in fps] == [(f, c) for f, _, c in want], (bits, tile)


def test_crowded_cells(spark):
    """All fingerprints with two bits in one segment pair share few cells, and each of them links with many."""
    fps = [(1 << a) | (1 << b) for a in range(32) for b in range(a)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for tile in (S.TILE, 64):
        found = S.links(df, 2, tile).collect()
        assert {x for p in found for x in p} == set(fps)
        assert S.components(S.links(df, 2, tile)).select("comp").distinct().count() == 1
    cells = S.cells(df).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    assert cells.agg(F.max("n")).first()[0] > 64


def test_counts(spark):
    fps = [0, -1, 1 << 62, -(1 << 63), 0x123456789ABCDEF]
    got = spark.createDataFrame([(f,) for f in fps], "fp long").select("fp", S.counts(F.col("fp")).alias("c")).collect()
    for f, c in got:
        assert c == sum((f % 2**64 >> 4 * s & 15).bit_count() << 4 * s for s in range(16))
        assert (c + S._ONES) % 2**64 == int(S._homes(np.array([f]))[0])


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = plain_components([(i, plain_fingerprint(t)) for i, t in docs])
    got = queries()["op12_simhash_dedup"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", c) for i, f, c in want)
