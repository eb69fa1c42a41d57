"""Substring dedup of word windows by a compressed FM-index per shard.

Stretches of words that may repeat are dealt to shards by minimizer (see ``_shards``). A shard's index is the
Burrows-Wheeler transform of its stretches in a wavelet matrix of packed bits with block counts, with the common prefixes
of neighbouring suffixes. Stretches are streamed through it from their last word to their first: backward search makes
the match longer at its start and, where that leaves one occurrence only, the parent interval makes it shorter at its
end. So each place gets its matching statistic, the length of the longest run from there that occurs elsewhere too, and
its suffix interval. A window whose statistic reaches its size is a repeat, and the interval of its size is its class.

Null texts have no words; texts of fewer words than a window lose nothing; places are ordered by id and place (a null
id first; rows of one id are one order). Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shards import NO_ID, Plan, Shard, repeats
from ._text import ranges
from .suffix import LANE, suffix_array


class Bits:
    """Packed bits with the count of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(raw.tobytes() + bytes(16 - len(raw) % 8), "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        k = i >> 6
        return self.before[k] + np.bitwise_count(self.words[k] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Index:
    """FM-index of a sequence of tokens from 0 to sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int, most: int = 1 << 20):
        self.n = len(text)
        two = text.astype(np.int64) * (sigma + 1)
        two[:-1] += text[1:] + 1
        order = suffix_array(two, 2)
        #: Tokens that the suffix before a place in order shares with the one there (0 at both ends), at most ``most``.
        self.common = np.append(common_tokens(text, order, most), np.int32(0))
        self.smaller = smaller(self.common)
        last = text[order - 1]  # the transform; the first suffix is preceded by the last token
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels: list[Bits] = []
        for k in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (last >> k) & 1
            self.levels.append(Bits(bit.astype(bool)))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        depth = len(self.levels)
        # where each token's block starts on the last level
        self.base = np.zeros(sigma, np.int64)
        tokens = np.arange(sigma)
        for j, b in enumerate(self.levels):
            one = (tokens >> (depth - 1 - j)) & 1 == 1
            r = b.rank(self.base)
            self.base = np.where(one, b.zeros + r, self.base - r)

    def back(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c followed by what lo to hi stand for."""
        at, n, depth = np.concatenate([lo, hi]), len(lo), len(self.levels)
        for j, b in enumerate(self.levels):
            one = (c >> (depth - 1 - j)) & 1 == 1
            r = b.rank(at)
            at = np.where(np.concatenate([one, one]), b.zeros + r, at - r)
        first = self.starts[c] - self.base[c]
        return at[:n] + first, at[n:] + first


    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals, and lengths, of the longest shorter prefixes of what lo to hi stand for that occur more often."""
        k = np.where(self.common[lo] > self.common[hi], lo, hi)
        before, after = self.smaller
        return before[k], after[k], self.common[k]


def common_tokens(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix in tokens, at least up to most, of each suffix in order with the one before it, by Kasai's rule: lanes
    of the text go left to right together, and each place starts from the last one's length less one."""
    n = len(text)
    padded = np.full(n + 2, -1, np.int32)
    padded[:n] = text
    two = np.ndarray(n + 1, "<u8", buffer=padded, strides=(4,))  # two tokens at a time
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.concatenate([[0], order])[place]
    out = np.zeros(n, np.int32)
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
        on = np.flatnonzero((have < most) & (place[i] > 0))
        while len(on):
            at, other = i[on] + have[on], p[on] + have[on]
            inner = (at < n) & (other < n)
            x = two[np.minimum(at, n)] ^ two[np.minimum(other, n)]
            one, both = inner & ((x & np.uint64(0xFFFFFFFF)) == 0), inner & (x == 0) & (at + 1 < n) & (other + 1 < n)
            have[on] += one.astype(np.int64) + both
            on = on[both & (have[on] < most)]
        have[place[i] == 0] = 0
        out[place[i]] = np.minimum(have, most)
    return out


def smaller(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place before and after each with a smaller value (0 and the last place where there is none)."""
    out = []
    for y in (x, x[::-1]):
        to = np.maximum(np.arange(-1, len(y) - 1), 0)
        on = np.flatnonzero((y[to] >= y) & (to > 0))
        while len(on):  # what lies between a place and where it points is not smaller, so pointers may be followed
            to[on] = to[to[on]]
            on = on[(y[to[on]] >= y[on]) & (to[on] > 0)]
        out.append(to)
    return out[0], (len(x) - 1 - out[1])[::-1]


def matching_statistics(index: Index, text: np.ndarray, firsts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the stretches of text (one after the other): how long a run from there, within its stretch, occurs
    more than once in the index, and where the interval of that run's suffixes begins. All stretches go together."""
    base = np.cumsum(lens) - lens
    stat, at = np.zeros(int(lens.sum()), np.int64), np.zeros(int(lens.sum()), np.int64)
    on = np.flatnonzero(lens)
    i, lo, hi, m = lens[on] - 1, np.zeros(len(on), np.int64), np.full(len(on), index.n), np.zeros(len(on), np.int64)
    while len(on):
        new_lo, new_hi = index.back(text[firsts[on] + i], lo, hi)
        longer = new_hi - new_lo > 1
        none = ~longer & (m == 0)
        cut = ~longer & ~none
        lo, hi, m = np.where(longer, new_lo, lo), np.where(longer, new_hi, hi), m + longer
        if cut.any():
            lo[cut], hi[cut], m[cut] = index.parent(lo[cut], hi[cut])
        done = longer | none
        to = base[on[done]] + i[done]
        stat[to], at[to] = m[done], lo[done]
        i = i - done
        left = i >= 0
        if not left.all():
            on, i, lo, hi, m = on[left], i[left], lo[left], hi[left], m[left]
    return stat, at


def _indexed(tokens: np.ndarray, lens: np.ndarray) -> tuple[Index, np.ndarray, np.ndarray]:
    """The index of stretches, their text with a 0 after each, and where each begins in it."""
    words, ids = np.unique(tokens, return_inverse=True)
    text = np.zeros(len(tokens) + len(lens), np.int64)
    text[np.arange(len(tokens)) + np.repeat(np.arange(len(lens)), lens)] = ids + 1
    return Index(text, len(words) + 1, int(lens.max(initial=0)) + 1), text, np.cumsum(lens + 1) - lens - 1


def repeated_intervals(tokens: np.ndarray, lens: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Stretch, start and end of each run of size tokens or more that occurs elsewhere too and, as such, is not within a
    longer one of its stretch."""
    index, text, firsts = _indexed(tokens, lens)
    stat, _ = matching_statistics(index, text, firsts, lens)
    inner = ranges(np.zeros(len(lens), np.int64), lens)
    whole = np.ones(len(stat), bool)
    whole[1:] = (inner[1:] == 0) | (inner[1:] + stat[1:] > inner[:-1] + stat[:-1])
    at = np.flatnonzero(whole & (stat >= size))
    return list(zip(np.repeat(np.arange(len(lens)), lens)[at].tolist(), inner[at].tolist(), (inner + stat)[at].tolist(), strict=True))


def repeated_windows(tokens: np.ndarray, lens: np.ndarray, size: int) -> np.ndarray:
    """Class of each window of each stretch: equal for equal windows."""
    index, text, firsts = _indexed(tokens, lens)
    stat, at = matching_statistics(index, text, firsts, lens)
    win = ranges(np.cumsum(lens) - lens, lens - size + 1)
    stat, at = stat[win], at[win]
    return np.where(stat >= size, np.cumsum(index.common[:-1] < size)[at], -1 - np.arange(len(win)))


def _finish(digests: bool):
    def run(s: Shard, gone: np.ndarray) -> pa.RecordBatch:
        rows = []
        keep = ~gone
        lens = np.where(keep, s.ends - s.starts, 0)
        for k, id_ in enumerate(s.ids.tolist()):
            a, b = s.firsts[k], s.firsts[k + 1]
            m = keep[a:b]
            st, n = s.starts[a:b][m], lens[a:b][m]
            kept = b""
            if len(st):
                out = np.full(int(n.sum()) + len(n) - 1, 32, np.uint8)
                out[ranges(np.cumsum(n + 1) - n - 1, n)] = s.data[ranges(st, n)]
                kept = out.tobytes()
            rows.append((None if id_ == NO_ID else id_, int(b - a), int(b - a - m.sum()), hashlib.sha256(kept).hexdigest() if digests else kept.decode()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def window_dedup(docs: DataFrame, key: str = "doc_id", col: str = "text", size: int = 20, digests: bool = False) -> DataFrame:
    """key, n_words, n_removed and kept (words joined by a space), or kept_sha256."""
    out = repeats(docs, key, col, Plan(True, size, 6, repeated_windows), _finish(digests), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    return out.toDF(key, "n_words", "n_removed", "kept_sha256" if digests else "kept")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return window_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
