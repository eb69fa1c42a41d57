"""Substring dedup by suffix arrays: bytes under a 50-byte string that starts in an earlier document go.

Stretches that may repeat are dealt to shards by minimizer (see ``_shards``). A shard's suffix array comes from
Larsson-Sadakane refinement (prefix doubling over the groups that are still tied), adjacent common prefixes from
Kasai's rule run in lanes, and runs of common prefixes of 50 bytes or more are the equal windows. Shards' sorted keys
and windows are merged by binary search.

Null texts count as empty; texts under 50 bytes lose nothing; rows with equal ids don't remove each other; a null id is
before all others. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shards import NO_ID, Plan, Shard, repeats
from ._text import ranges

LANE = 256


def suffix_array(keys: np.ndarray, have: int) -> np.ndarray:
    """Order of all suffixes. keys: rank of each suffix's first ``have`` tokens, in a form that sorts."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.full(n + 1, -1, np.int64)
    sorted_keys = keys[order]
    head = np.ones(n, bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(tied):
        i = order[tied]
        both = rank[i] * (n + 2) + rank[np.minimum(i + have, n)] + 1
        o = np.argsort(both, kind="stable")
        i, both = i[o], both[o]
        order[tied] = i
        head = np.ones(len(i), bool)
        head[1:] = both[1:] != both[:-1]
        rank[i] = tied[np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))]
        tied = tied[~(head & np.concatenate([head[1:], [True]]))]
        have *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix (in bytes, at least up to ``most``) of each suffix in order with the one before it. Lanes of the
    text go left to right together; each place starts from the last one's length less one."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    w = np.ndarray(n + most + 8, "<u8", buffer=padded, strides=(1,))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.concatenate([[0], order])[place]
    out = np.zeros(n, np.int16)
    lanes = np.arange(0, n, LANE)
    have = np.zeros(len(lanes), np.int64)
    for j in range(LANE):
        i = lanes + j
        if i[-1] >= n:
            lanes, have, i = lanes[:-1], have[:-1], i[:-1]
            if not len(i):
                break
        p = before[i]
        have = np.maximum(have - 1, 0)
        on = np.flatnonzero(have < most)
        while len(on):
            x = w[i[on] + have[on]] ^ w[p[on] + have[on]]
            same = x == 0
            low = x & (~x + np.uint64(1))
            have[on] += np.where(same, 8, np.log2(np.where(same, 1, low).astype(np.float64)).astype(np.int64) // 8)
            on = on[same & (have[on] < most)]
        np.minimum(have, most, out=have)
        have[place[i] == 0] = 0
        out[i] = have
    return out[order]


def equal_windows(data: np.ndarray, lens: np.ndarray, size: int) -> np.ndarray:
    """Class of each window of each stretch: equal for equal windows."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.ndarray(len(data), "<u8", buffer=padded, strides=(1,)).byteswap()
    order = suffix_array(keys, 8)
    common = common_prefixes(data, order, size)
    cls = np.empty(len(data), np.int64)
    cls[order] = np.cumsum(common < size)
    firsts = np.cumsum(lens) - lens
    return cls[ranges(firsts, lens - size + 1)]


def _finish(digests: bool):
    def run(s: Shard, gone: np.ndarray) -> pa.RecordBatch:
        rows = []
        for k, id_ in enumerate(s.ids.tolist()):
            a, b = s.offs[k], s.offs[k + 1]
            g = gone[a:b]
            edge = np.flatnonzero(np.diff(g, prepend=False, append=False)) if len(g) else np.zeros(0, np.int64)
            kept = s.data[a:b][~g].tobytes()
            rows.append((None if id_ == NO_ID else id_, len(g), int(g.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest()) if digests else (None if id_ == NO_ID else id_, len(g), int(g.sum()), edge.reshape(-1, 2).tolist(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), *((pa.int64(), pa.string()) if digests else (pa.list_(pa.list_(pa.int64())), pa.binary()))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def substring_dedup(docs: DataFrame, key: str = "doc_id", col: str = "text", size: int = 50, digests: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, spans removed (start, past the end) and kept bytes; or n_spans and kept_sha256."""
    last = "spans bigint, kept string" if digests else "spans array<array<bigint>>, kept binary"
    out = repeats(docs, key, col, Plan(False, size, 16, equal_windows), _finish(digests), f"doc_id bigint, n_bytes bigint, n_removed bigint, {last}")
    return out.toDF(key, "n_bytes", "n_removed", *(("n_spans", "kept_sha256") if digests else ("spans", "kept")))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
