"""Arrow and numpy helpers that the text operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def lut(words: str) -> np.ndarray:
    """Mask by byte: "space" splits at white space, "alnum" at all ASCII but letters and digits."""
    ok = np.ones(256, dtype=bool)
    if words == "space":
        ok[[32, *range(9, 14)]] = False
    else:
        ok[:128] = False
        for a, b in ((48, 58), (65, 91), (97, 123)):
            ok[a:b] = True
    return ok


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and each row's offsets in them; null counts as empty."""
    a = batch.column(batch.schema.get_field_index(name))
    if a.null_count:
        a = pc.fill_null(a, b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else "")
    a = a.cast(pa.large_binary())
    offs = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], name: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = columns(batch, name)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def spans(data: np.ndarray, offs: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of the first word of each row (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = ok[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = m[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = m[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(m & ~before)
    return starts, np.flatnonzero(m & ~after) + 1, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K1
    return (h ^ (h >> np.uint64(29))) * _K2


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    lens = ends - starts
    h = mix(lens.astype(np.uint64) * _K1 + np.uint64(seed))
    on, at = np.arange(len(starts)), 0
    while len(on := on[lens[on] > at]):
        chunk = words[starts[on] + at] & _MASKS[np.minimum(lens[on] - at, 8)]
        h[on] = mix(h[on] ^ chunk)
        at += 8
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes (across rows too; callers drop those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(h[:n])
    for j in range(1, k):
        out = mix(out ^ h[j : j + n] ^ np.uint64(j))
    return out ^ (out >> np.uint64(31))


def inside(firsts: np.ndarray, total: int, k: int) -> np.ndarray:
    """Mask over total-k+1 positions: true where k items from there stay in one row. firsts: row boundaries in items."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    mark = np.zeros(total + 1, dtype=np.int32)
    ends = firsts[1:]
    lo = np.maximum(ends - (k - 1), firsts[:-1])
    np.add.at(mark, lo, 1)
    np.add.at(mark, ends, -1)
    return np.cumsum(mark)[:n] == 0


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated arange(s, s + n) for each pair."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.arange(total) - np.repeat(first - starts, lens)


def sha(b: bytes | memoryview) -> str:
    return hashlib.sha256(b).hexdigest()
