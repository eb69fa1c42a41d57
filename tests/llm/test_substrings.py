"""Operators 4 and 9 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslattice.llm import _shards, fmindex, suffix


def brute_bytes(rows, size):
    first = {}
    for k, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - size + 1):
            w = raw[i : i + size]
            first[w] = min(first.get(w, k), k)
    out = {}
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if first[raw[i : i + size]] < k:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.setdefault(k, set()).add((len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, size):
    split = lambda t: re.findall("[^\\x20\\x09-\\x0d]+", t or "")
    first = {}
    for k, t in rows:
        w = split(t)
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            first[x] = min(first.get(x, (k, i)), (k, i))
    out = {}
    for k, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (k, i):
                gone[i : i + size] = [True] * size
        out.setdefault(k, set()).add((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def docs(spark, sf):
    rnd = random.Random(1)
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120).collect()
    rows = [tuple(r) for r in base]
    words = "the of and to in is it that for was on are as with".split()
    hot = " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(60))
    for k in range(60):
        own = " ".join(rnd.choice(words) for _ in range(rnd.randrange(80)))
        cut = rnd.randrange(200)
        rows.append((1000 + k, f"{own} {hot[cut:]} {own} {hot[:cut]}\n\tüß {own}"))
    rows += [(2000, None), (2001, ""), (2002, "x" * 3000), (2003, "x" * 900 + "y"), (2004, "a b " * 700), (2005, "b a " * 30), (-5, hot), (2006, "q" * 49), (2007, "q" * 50), (2008, "q" * 51)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, docs, small, monkeypatch):
    if small:
        monkeypatch.setattr(_shards, "SHARD_BYTES", 20_000)
        monkeypatch.setattr(_shards, "BUCKET_BYTES", 30_000)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({"shard": F.lit("x"), "got": F.lit(1)})
    want = brute_bytes(docs, 50)
    got = suffix.substring_dedup(df, digests=True).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r[1:]) in want[r[0]], (r, want[r[0]], dict(docs)[r[0]][:80])
    want = brute_words(docs, 20)
    got = fmindex.window_dedup(df, digests=True).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r[1:]) in want[r[0]], (r, want[r[0]])


def test_texts_longer_than_a_shard(spark, monkeypatch):
    """One text fills several shards' bytes; it shares passages with others and repeats some of its own."""
    monkeypatch.setattr(_shards, "SHARD_BYTES", 8_000)
    monkeypatch.setattr(_shards, "BUCKET_BYTES", 8_000)
    rnd = random.Random(6)
    own = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(7000)) for _ in range(2)]
    rows = [(3, own[0]), (1, own[1][5000:9000]), (2, f"{own[0][20_000:24_000]} then {own[1][:3000]}"), (4, f"{own[1]} {own[1][100:2000]}"), (5, "short"), (6, own[0])]
    assert len(own[0]) > 4 * 8_000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_bytes(rows, 50)
    assert all(tuple(r[1:]) in want[r[0]] for r in suffix.substring_dedup(df, digests=True).collect())
    want = brute_words(rows, 20)
    assert all(tuple(r[1:]) in want[r[0]] for r in fmindex.window_dedup(df, digests=True).collect())


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, long), (None, long), (None, "z"), (3, long + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r[0] or -1, r[2], r[3]) for r in fmindex.window_dedup(df).collect()))
    assert got == [(-1, 0, long), (-1, 0, "z"), (1, 40, ""), (1, 40, ""), (3, 40, "tail")]
    got = suffix.substring_dedup(df).collect()
    assert sorted(((r[0] or -1, r.n_removed, len(r.spans)) for r in got)) == sorted([(-1, 0, 0), (-1, 0, 0), (1, len(long), 1), (1, len(long), 1), (3, len(long), 1)])
    assert suffix.substring_dedup(df.limit(0)).count() == 0 and fmindex.window_dedup(df.limit(0)).count() == 0


def test_suffix_parts():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 100, 3000).astype(np.uint8)
    raw = data.tobytes()
    keys = np.ndarray(3000, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).byteswap()
    order = suffix.suffix_array(keys, 8)
    assert order.tolist() == sorted(range(3000), key=lambda i: raw[i:])
    lcp = suffix.common_prefixes(data, order, 50)
    for k in range(1, 3000):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, 50)
    text = np.append(rnd.integers(1, 11, 499), 0)
    ix = fmindex.Index(text, 11)
    for _ in range(200):
        n, i = rnd.integers(1, 4), rnd.integers(0, 490)
        p = text[i : i + n]
        lo, hi = np.array([0]), np.array([500])
        for c in p[::-1]:
            lo, hi = ix.back(np.array([c]), lo, hi)
        want = sum((text[j : j + n] == p).all() for j in range(500 - n + 1))
        assert hi[0] - lo[0] == want


def test_matching_statistics():
    rnd = np.random.default_rng(4)
    for sigma, n in ((2, 40), (3, 60), (12, 30)):
        lens = rnd.integers(1, 30, n)
        tokens = rnd.integers(0, sigma, lens.sum())
        parts = [p.tolist() for p in np.split(tokens, np.cumsum(lens)[:-1])]
        parts[3] = list(parts[5])
        lens = np.array([len(p) for p in parts])
        tokens = np.array([x for p in parts for x in p])

        def times(run):
            return sum(p[i : i + len(run)] == run for p in parts for i in range(len(p) - len(run) + 1))

        want = [max((m for m in range(1, len(p) - i + 1) if times(p[i : i + m]) > 1), default=0) for p in parts for i in range(len(p))]
        index, text, firsts = fmindex._indexed(tokens, lens)
        stat, at = fmindex.matching_statistics(index, text, firsts, lens)
        assert stat.tolist() == want
        where = [(k, i) for k, p in enumerate(parts) for i in range(len(p))]
        runs = {(k, i, i + m) for (k, i), m in zip(where, want) if m >= 3}
        runs = {x for x in runs if not any(y != x and y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] for y in runs)}
        assert set(fmindex.repeated_intervals(tokens, lens, 3)) == runs
        long = np.array([k for k in range(len(parts)) if lens[k] >= 3])
        cls = fmindex.repeated_windows(np.concatenate([np.array(parts[k]) for k in long]), lens[long], 3)
        wins = [tuple(parts[k][i : i + 3]) for k in long for i in range(lens[k] - 2)]
        seen = {}
        for w, c in zip(wins, cls.tolist()):
            assert seen.setdefault(w, c) == c
        assert len(set(seen.values())) == len(seen)
        x = index.common
        before, after = fmindex.smaller(x)
        for k in range(len(x)):
            assert before[k] == max((j for j in range(k) if x[j] < x[k]), default=0) and after[k] == min((j for j in range(k + 1, len(x)) if x[j] < x[k]), default=len(x) - 1)
