"""BPE encoding and decoding by speculation and verification.

A word's encoding is proposed by greedy longest match. A sequence of tokens is the merge result exactly if each token is
what its own characters merge to and each adjacent pair is what the pair's characters merge to; so the pairs of all new
words of a batch are checked together against the pairs known to hold, and only words with a failing pair are merged
exactly, in the order of the merge ranks. New words go through all three steps together, as rows of symbols in numpy;
a longer word goes through the same steps alone, with a heap of pairs, in n log n.

The vocabulary file's place is a parameter (``public_tokenizers.path``); it is read on the executors, never copied.
Null counts as the empty text: no tokens, empty decoded text. Repeated rows give equal values. What a worker remembers of
words and pairs is bounded (``CACHE``, ``PAIRS``) and changes no result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import pieces, ranges

VOCABULARY = "word_bpe_49k.json"
#: The white space of the tokenizer's patterns, and the patterns themselves.
SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_ASCII = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-z0-9]+")
#: The same words as _WORDS for texts whose numbers are all decimal digits.
_DECIMAL = re.compile(rf"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w{SPACE}]|_)+")
END = "</w>"
#: Words held in a generation, pairs held, bytes of text encoded together.
CACHE, PAIRS, PIECE = 100_000, 400_000, 1 << 20
#: Letters of the words held in a generation: few long words fill it as well.
LETTERS = 4_000_000
#: Symbols of a word that is merged, or matched, together with others.
WIDE, WIDEST = 256, 2048
NEVER = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def _find(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x would be in known, which is sorted, and which of x are there."""
    at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
    return at, known[at] == x if len(known) else np.zeros(len(x), bool)


class Merges:
    """Merge ranks of pairs of tokens."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]):
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NEVER where there is none (negative tokens are none)."""
        at, there = _find((a.astype(np.int64) << 32 | b).ravel(), self.pairs)
        return np.where(there, self.ranks[at] if len(self.ranks) else 0, NEVER).reshape(a.shape)

    def rows(self, m: np.ndarray) -> np.ndarray:
        """Each row of tokens (-1 after its end) merged: the pair of the lowest rank, leftmost first, until none is left."""
        out, at = m.copy(), np.arange(len(m))
        rank = self.of(m[:, :-1], m[:, 1:])
        wide = np.arange(m.shape[1])
        while True:
            k = rank.argmin(1)
            low = rank[np.arange(len(rank)), k]
            on = low < NEVER
            if not on.all():
                out[at[~on]] = m[~on]
                m, rank, at, k, low = m[on], rank[on], at[on], k[on], low[on]
            if not len(m):
                return out
            n = np.arange(len(m))
            m[n, k] = self.made[low]
            move = wide + (wide > k[:, None])
            m = np.take_along_axis(np.pad(m, ((0, 0), (0, 1)), constant_values=-1), move, 1)
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=NEVER), move[:, :-1], 1)
            left = n[k > 0]
            rank[left, k[left] - 1] = self.of(m[left, k[left] - 1], m[left, k[left]])
            right = n[k < rank.shape[1]]
            rank[right, k[right]] = self.of(m[right, k[right]], m[right, k[right] + 1])

    def one(self, tokens: list[int], rank: dict[int, int]) -> list[int]:
        """The same for one row of any length, by a heap of (rank, place). rank: of pairs (first << 32 | second)."""
        tokens, n = list(tokens), len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (x, y) in enumerate(zip(tokens, tokens[1:], strict=False)) if (r := rank.get(x << 32 | y)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j >= n or rank.get(tokens[i] << 32 | tokens[j]) != r:
                continue
            tokens[i], tokens[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(tokens[i] << 32 | tokens[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get(tokens[h] << 32 | tokens[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in tokens if x >= 0]

    def all(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many rows of tokens, one after the other, merged: the same form. Rows of like length go together."""
        firsts = np.cumsum(lens) - lens
        new, parts, width = lens.copy(), [], 4
        while width < WIDE:
            width *= 2
            which = np.flatnonzero((lens <= width) & (lens > (width // 2 if width > 8 else 0)))
            for some in np.array_split(which, max(1, len(which) * width // 4_000_000)) if len(which) else ():
                m = np.full((len(some), width), -1, np.int32)
                n = lens[some]
                m[np.repeat(np.arange(len(some)), n), ranges(np.zeros(len(some), np.int64), n)] = flat[ranges(firsts[some], n)]
                m = self.rows(m)
                new[some] = (m >= 0).sum(1)
                parts.append((some, m[m >= 0]))
        long = np.flatnonzero(lens > width).tolist()
        rank = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True)) if long else {}
        for i in long:
            x = np.array(self.one(flat[firsts[i] : firsts[i] + lens[i]].tolist(), rank), np.int32)
            new[i] = len(x)
            parts.append((np.array([i]), x))
        firsts = np.cumsum(new) - new
        out = np.empty(int(new.sum()), np.int32)
        for some, x in parts:
            out[ranges(firsts[some], new[some])] = x
        return out, new


class Coder:
    """Encoder of texts, with what it has learnt about words and pairs of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.shown = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in [*ids.items(), *self.special.items()]:
            self.shown[i] = t
        self.merges = Merges(ids, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]])
        letters = byte_letters()
        #: Token of each byte, within a word and at its end; -1 where the vocabulary has none.
        self.symbol = np.array([[ids.get(x, -1) for x in letters], [ids.get(x + END, -1) for x in letters]], np.int32)
        self._tree(ids, {x: k for k, x in enumerate(letters)})
        self.good, self.bad = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.young: dict = {}
        self.letters = 0
        self.old: dict = {}
        self.held = self.before = (np.zeros(0, np.int32), np.zeros(1, np.int64))
        self.exact = 0

    def _tree(self, ids: dict[str, int], byte: dict[str, int]) -> None:
        """Prefix tree of the tokens that are what their own symbols merge to. An edge is (node, byte, last of a word)."""
        spelt, names = [], []
        for t, i in ids.items():
            end = t.endswith(END) and len(t) > len(END)
            s = [byte.get(x, -1) for x in (t[: -len(END)] if end else t)]
            if s and min(s) >= 0:
                s[-1] += 256 * end
                if all(self.symbol[x >> 8, x & 255] >= 0 for x in s):
                    spelt.append(s)
                    names.append(i)
        lens = np.array([len(s) for s in spelt], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *map(np.array, spelt)])
        tokens = self.symbol[flat >> 8, flat & 255]
        made, n = self.merges.all(tokens, lens)
        ends = np.cumsum(n)
        edges: dict[int, int] = {}
        accept = [-1]
        for k, s in enumerate(spelt):
            if n[k] == 1 and made[ends[k] - 1] == names[k]:
                at = 0
                for x in s:
                    if (to := edges.get(at << 9 | x)) is None:
                        to = edges[at << 9 | x] = len(accept)
                        accept.append(-1)
                    at = to
                accept[at] = names[k]
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edges, self.to = keys[order], np.array(list(edges.values()), np.int32)[order]
        self.accept = np.array(accept, np.int32)
        #: The symbols of each token, for pairs.
        self.spelt = np.zeros(len(self.shown), np.int64), np.zeros(len(self.shown), np.int64), tokens
        self.spelt[0][names], self.spelt[1][names] = np.cumsum(lens) - lens, lens

    def propose(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over each word's edges, all words together: tokens and the number of each word's."""
        firsts = np.cumsum(lens) - lens
        ends = firsts + lens
        on = np.flatnonzero((lens > 0) & (lens <= WIDEST))
        at, node = firsts[on], np.zeros(len(on), np.int64)
        best, stop = np.full(len(on), -1, np.int32), at.copy()
        words, tokens = [], []
        while len(on):
            inner = at < ends[on]
            edge, go = _find(node << 9 | flat[np.minimum(at, len(flat) - 1)], self.edges)
            go &= inner
            node = np.where(go, self.to[edge], 0)
            at = at + go
            hit = go & (self.accept[node] >= 0)
            best, stop = np.where(hit, self.accept[node], best), np.where(hit, at, stop)
            out = ~go
            words.append(on[out])
            tokens.append(best[out])
            at, best = np.where(out, stop, at), np.where(out, -1, best)
            more = ~out | (stop < ends[on])
            if not more.all():
                on, at, node, best, stop = on[more], at[more], node[more], best[more], stop[more]
        if len(long := np.flatnonzero(lens > WIDEST)):
            tree, accept = dict(zip(self.edges.tolist(), self.to.tolist(), strict=True)), self.accept.tolist()
            for k in long.tolist():
                made = self._longest(flat[firsts[k] : ends[k]].tolist(), tree, accept)
                words.append(np.full(len(made), k))
                tokens.append(np.array(made, np.int32))
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(lens), np.int64)
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        return tokens[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(lens))

    @staticmethod
    def _longest(word: list[int], tree: dict[int, int], accept: list[int]) -> list[int]:
        """Greedy longest match of one word of any length."""
        out, start, n = [], 0, len(word)
        while start < n:
            node, at = 0, start
            while at < n and (to := tree.get(node << 9 | word[at])) is not None:
                node, at = to, at + 1
                if accept[node] >= 0:
                    best, stop = accept[node], at
            out.append(best)
            start = stop
        return out

    def verify(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs of tokens are what their symbols merge to."""
        new = np.unique(pairs)
        new = new[~(_find(new, self.good)[1] | _find(new, self.bad)[1])]
        if len(new):
            if len(self.good) + len(self.bad) > PAIRS:
                self.good = self.bad = np.zeros(0, np.int64)
                new = np.unique(pairs)
            two = np.stack([new >> 32, new & 0xFFFFFFFF], axis=1)
            first, lens, tokens = self.spelt
            made, n = self.merges.all(tokens[ranges(first[two.ravel()], lens[two.ravel()])], lens[two].sum(1))
            at = np.minimum(np.cumsum(n) - n, len(made) - 2)
            ok = (n == 2) & (made[at] == two[:, 0]) & (made[at + 1] == two[:, 1])
            self.good, self.bad = np.union1d(self.good, new[ok]), np.union1d(self.bad, new[~ok])
        return _find(pairs, self.good)[1]

    def learn(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of new words, one after the other, and how many each has. A special token is a tuple of its own."""
        raws = [b"" if isinstance(w, tuple) else w.encode() for w in words]
        lens = np.array([len(r) for r in raws], np.int64)
        edge = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        edge[np.cumsum(lens)[lens > 0] - 1] += 256
        there = self.symbol[edge >> 8, edge & 255] >= 0  # bytes without a token are left out
        if not there.all():
            lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[there], minlength=len(lens))
            edge = edge[there]
        flat, n = self.propose(edge, lens)
        owner = np.repeat(np.arange(len(n)), n)
        beside = owner[1:] == owner[:-1]
        fails = np.zeros(len(n), bool)
        fails[owner[1:][beside][~self.verify((flat[:-1][beside].astype(np.int64) << 32) | flat[1:][beside])]] = True
        if len(again := np.flatnonzero(fails)):
            self.exact += len(again)
            firsts = np.cumsum(lens) - lens
            x = edge[ranges(firsts[again], lens[again])]
            made, m = self.merges.all(self.symbol[x >> 8, x & 255], lens[again])
            keep = ~fails[owner]
            owner = np.concatenate([owner[keep], np.repeat(again, m)])
            flat = np.concatenate([flat[keep], made])
        if len(special := [k for k, w in enumerate(words) if isinstance(w, tuple)]):
            owner = np.concatenate([owner, special])
            flat = np.concatenate([flat, [self.special[words[k][0]] for k in special]]).astype(np.int32)
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _add(self, words: list, flat: np.ndarray, n: np.ndarray) -> None:
        self.letters += sum(map(len, words))
        self.young.update(zip(words, range(len(self.young), len(self.young) + len(words)), strict=True))
        self.held = np.concatenate([self.held[0], flat]), np.concatenate([self.held[1], self.held[1][-1] + np.cumsum(n)])

    def _new(self, each: list[list]) -> tuple[set, list]:
        """Words that are not in the young generation: those that must be learnt, and those of the old one."""
        new = set().union(*each) - self.young.keys()
        again = [w for w in new if w in self.old]
        new.difference_update(again)
        return new, again

    def split(self, text: str, plain: bool = True) -> list[str]:
        """The words of a text without special tokens. plain: its numbers are decimal digits."""
        if text.isascii():
            return _ASCII.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (_DECIMAL if plain else _WORDS).findall(text)

    def words(self, text: str, plain: bool = True) -> list:
        """The words of a text; special tokens are tuples."""
        if not any(t in text for t in self.special):
            return self.split(text, plain)
        out: list = []
        for k, part in enumerate(self.cut.split(text)):
            out += [(part,)] if k % 2 else self.split(part, plain)
        return out

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each text's begin (one more entry than texts)."""
        if len(self.young) > CACHE or self.letters > LETTERS:  # words not used in a whole generation are forgotten
            self.old, self.before, self.letters = self.young, self.held, 0
            self.young, self.held = {}, (np.zeros(0, np.int32), np.zeros(1, np.int64))
        each = [self.words(t) for t in texts]
        new, again = self._new(each)
        if any(not w.isalpha() and w[0].isalnum() and not w.isdecimal() for w in new if not isinstance(w, tuple) and not w.isascii()):
            each = [self.words(t, False) for t in texts]
            new, again = self._new(each)
        if again:
            at = np.fromiter(map(self.old.__getitem__, again), np.int64, len(again))
            flat, ends = self.before
            n = ends[at + 1] - ends[at]
            self._add(again, flat[ranges(ends[at], n)], n)
        if new:
            fresh = list(new)
            self._add(fresh, *self.learn(fresh))
        at = np.array([*map(self.young.__getitem__, itertools.chain.from_iterable(each))], np.int64)
        flat, ends = self.held
        n = ends[at + 1] - ends[at]
        cut = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, each)])]
        return flat[ranges(ends[at], n)], cut

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers, and the decoded text, of each text."""
        flat, cut = self.tokens(texts)
        raw, shown = flat.astype("<u4").tobytes(), list(map(self.shown.__getitem__, flat.tolist()))
        return [(raw[4 * a : 4 * b], " ".join(shown[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        """The library's decoding without a decoder: the tokens, specials included, joined by a space."""
        return " ".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(df: DataFrame, col: str = "text", key: str = "doc_id", path: str | None = None, digests: bool = False) -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit), decoded; or their SHA-256 instead of the last two."""

    def run(batches):
        made = coder(path or default_path())
        for b in pieces(batches, "t", PIECE):
            n, ids, texts = [], [], []
            for raw, text in made.encode([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest() if digests else raw)
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.binary()), pa.array(texts, pa.string())], names=["k", "n", "ids", "decoded"])

    kind = dict(df.dtypes)[key]
    a, b = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{col}`").cast("string").alias("t")).mapInArrow(run, f"k {kind}, n bigint, ids {'string' if digests else 'binary'}, decoded string").toDF(key, "n_tokens", a, b)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
