"""Toxicity by noisy-channel deobfuscation.

Words written in leetspeak, with marks or blanks between letters or with repeated letters are character lattices; a
Viterbi search under a character trigram model picks the likeliest spelling, and the restored words are scored.

``fit_channel(docs)`` counts the trigrams of every text (at most 28^3 numbers). ``fit_words(docs)`` learns, from at most
``max_docs`` distinct labelled texts, which restored words and word starts mark toxic texts; half of the texts (by hash) give the features, the other half
turns raw scores into shares of toxic texts. ``score(df, model)`` reads
whole texts; a word's share is the largest share of toxic texts (shrunk to the base rate) among its features, and a
text's raw score is the chance that one of its distinct words at least marks it, each taken by itself.

Null, empty and wordless texts score as texts without any marked word; repeated rows score alike; without labels (or
with labels of one kind only) every text gets the base rate's score. Other columns are kept (score is replaced).
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import columns, pieces

S = 28  # symbols: 0 between words, 1 to 26 a to z, 27 other letters
#: A feature occurs in LEAST toxic texts, its share is shrunk by SHRINK texts of the base rate and SURE deviations above it.
THRESHOLD, STARTS, SHRINK, SURE, LEAST = 0.3, (3, 4, 5, 6), 10, 5, 5
CACHE = 400_000
#: Letters of the tokens that a task remembers, so that few long ones fill it as well.
LETTERS = 8_000_000
#: What letters a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
GAPS = set(".-_*~'`^,:;/\\")
_SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*]\S){2,}(?!\S)")
_RUN = re.compile(r"(.)\1\1")
_EDGE = re.compile(r"^[^\w@$|!+(€£]+|[^\w@$|+€£]+$")
_MAP = np.zeros(256, np.int64)
_MAP[97:123] = _MAP[65:91] = np.arange(1, 27)
_MAP[128:] = 27


def _trigrams(batches):
    total = np.zeros(S**3, np.int64)
    for b in pieces(batches, "text"):
        s = np.concatenate([[0, 0], _MAP[columns(b, "text")[0]], [0]])
        total += np.bincount((s[:-2] * S + s[1:-1]) * S + s[2:], minlength=S**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])


def fit_channel(docs: DataFrame, col: str = "text") -> dict[int, int]:
    rows = docs.select(F.col(col).cast("string").alias("text")).mapInArrow(_trigrams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n")).collect()
    return dict(map(tuple, rows))


@dataclass
class Channel:
    """Character model and lattice decoder. weight: how much of the counts the extra words make up."""

    counts: dict[int, int]
    words: tuple[str, ...] = ()
    weight: float = 0.05
    table: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        c = np.full(S**3, 0.1)
        for g, n in self.counts.items():
            c[g] += n
        each = self.weight * c.sum() / max(1, len(self.words))
        for w in self.words:
            s = [0, 0, *(ord(x) - 96 if "a" <= x <= "z" else 27 for x in w), 0]
            for x in zip(s, s[1:], s[2:], strict=False):
                c[(x[0] * S + x[1]) * S + x[2]] += each
        c = c.reshape(S, S, S)
        self.table = np.log(c / c.sum(2, keepdims=True)).tolist()

    def decode(self, text: str, spaced: bool = False) -> str:
        """Likeliest spelling; spaced allows word ends anywhere between letters. Characters that can be neither a letter nor
        left out are passed over. Of equally likely spellings, that whose states were reached first."""
        best = {(0, 0): 0.0}
        steps: list[dict] = []  # of each character: state to the state before it and what was written
        before = ""
        for ch in text.lower():
            ways = [(x, 0.0 if x == ch else -1.0) for x in ((ch,) if ch.isalpha() else LEET.get(ch, ""))]
            skip = -0.2 if ch in GAPS or ch == " " else -0.5 if ch == before and ch.isalpha() else -3.0 if not ch.isalpha() else None
            new: dict[tuple[int, int], float] = {}
            back: dict = {}

            def reach(to: tuple[int, int], q: float, came: tuple[int, int], wrote: str) -> None:
                if new.get(to, -math.inf) < q:
                    new[to], back[to] = q, (came, wrote)

            for (a, b), p in best.items():
                if skip is not None:
                    reach((a, b), p + skip, (a, b), "")
                for x, cost in ways:
                    k = ord(x) - 96 if "a" <= x <= "z" else 27
                    reach((b, k), p + cost + self.table[a][b][k], (a, b), x)
                    if spaced and b:
                        reach((0, k), p + cost - 1.0 + self.table[a][b][0] + self.table[b][0][k], (a, b), " " + x)
            if new:
                best = new
                steps.append(back)
            before = ch
        at = max(best, key=lambda s: best[s] + self.table[s[0]][s[1]][0])
        out = []
        for back in reversed(steps):
            at, wrote = back[at]
            out.append(wrote)
        return "".join(reversed(out))


@dataclass
class Restorer:
    """Restored words of a text, with what was decoded before. Plain words are only lower-cased."""

    channel: Channel
    cache: dict[str, str] = field(default_factory=dict)
    letters: int = 0

    def word(self, w: str) -> str:
        if w.isalpha() and not _RUN.search(w):
            return w.lower()
        core = _EDGE.sub("", w)
        if core.isalpha() and not _RUN.search(core):
            return core.lower()
        if (x := self.cache.get(core)) is None:
            if len(self.cache) > CACHE or self.letters > LETTERS:
                self.cache.clear()
                self.letters = 0
            self.letters += len(core)
            ends = core.strip("0123456789!|+$(@€£")
            x = self.cache[core] = self.channel.decode(core) if any(map(str.isalpha, core)) else ""
            if ends.isalpha() and not _RUN.search(ends):
                x = self.cache[core] = f"{x} {ends.lower()}"
        return x

    def words(self, text: str) -> set[str]:
        out = {x for w in set(text.split()) for x in self.word(w).split()}
        for m in _SPACED.finditer(text):
            if any(map(str.isalpha, m[0])):
                joined = self.channel.decode(m[0], spaced=True)
                out.update(joined.split())
                out.update(w for w in self.channel.words if w in joined.replace(" ", ""))
        return out


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STARTS if len(word) > n)]


def fit_words(labelled: DataFrame, channel: dict[int, int], max_docs: int = 40_000) -> dict:
    """labelled: text, toxic. Learns from max_docs texts at most, taken by hash. Features that LEAST and SURE keep
    are each in LEAST toxic ones of those at least, so max_docs bounds them too."""
    rows = labelled.where("toxic is not null").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("text"))
    n = rows.count()
    part = min(1.0, max_docs / max(1, n))
    rows = rows.where(F.pmod("h", F.lit(1_000_000)) < int(part * 1_000_000)).dropDuplicates(["h", "toxic"])
    rest = rows.where(F.pmod(F.shiftright("h", 20), F.lit(2)) == 1).select("text", "toxic")
    rows = rows.where(F.pmod(F.shiftright("h", 20), F.lit(2)) == 0).select("text", "toxic")
    base = {int(t): k for t, k in rows.groupBy("toxic").count().collect()}
    bad, all_ = base.get(1, 0), sum(base.values())
    prior = bad / all_ if all_ else 0.0

    def count(batches):
        restorer = Restorer(Channel(channel))
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["f", "toxic", "n"])
            seen.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen.update((f, toxic) for f in {f for w in restorer.words(text.as_py()) for f in features(w)})
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    got = rows.mapInArrow(count, "f string, toxic int, n bigint").groupBy("f").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n")).where(F.col("t") >= LEAST)
    got = got.withColumn("p", (F.col("t") + SHRINK * prior) / (F.col("n") + SHRINK))
    sure = (F.col("t") - F.col("n") * prior) / F.sqrt(F.col("n") * max(prior * (1 - prior), 1e-9)) >= SURE
    got = got.where((F.col("p") >= max(0.25, 2 * prior)) & sure)
    model = {"weights": {f: p for f, p in got.select("f", "p").collect()}, "prior": prior, "channel": channel, "steps": ()}
    return model | {"steps": steps(score(rest, model).select("score", "toxic").collect(), prior)}


def steps(seen: list[tuple[float, int]], prior: float) -> list[tuple[float, float]]:
    """Rising steps (least raw score, share of toxic texts): adjacent raw scores whose shares fall are pooled."""
    blocks: list[list[float]] = []
    for raw, toxic in sorted(map(tuple, seen)):
        if blocks and blocks[-1][0] == raw:
            blocks[-1][1] += toxic
            blocks[-1][2] += 1
        else:
            blocks.append([raw, toxic, 1])
        while len(blocks) > 1 and blocks[-2][0] != raw and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    return [(raw, (t + prior) / (n + 1)) for raw, t, n in blocks]


def together(shares: list[float], least: float) -> float:
    """Raw score of a text from its words' shares of toxic texts: the chance that one of them at least marks it."""
    clean = 1.0
    for p in shares:
        clean *= 1 - p
    return max(least, 1 - clean)


class Scorer:
    def __init__(self, model: dict):
        self.weights, self.rest = model["weights"], model["prior"] * (0.2 if model["weights"] else 1)
        words = [f for f, p in self.weights.items() if not f.endswith("-") and p >= 0.5]
        self.restorer = Restorer(Channel(model["channel"], tuple(words)))
        self.known: dict[str, float] = {}
        self.letters = 0
        self.steps = model["steps"]
        self.at = [x for x, _ in self.steps]

    def of_word(self, w: str) -> float:
        if (p := self.known.get(w)) is None:
            if len(self.known) > CACHE or self.letters > LETTERS:
                self.known.clear()
                self.letters = 0
            self.letters += len(w)
            p = self.known[w] = max((self.weights.get(f, 0.0) for f in features(w)), default=0.0)
        return p

    def score(self, text: str) -> float:
        raw = together(sorted(map(self.of_word, self.restorer.words(text))), self.rest)
        if not self.steps:
            return raw
        k = bisect.bisect_right(self.at, raw)
        return self.steps[k - 1][1] * (1 - 1e-6) + raw * 1e-6 if k else self.steps[0][1]


def score(df: DataFrame, model: dict, col: str = "text") -> DataFrame:
    keep = [c for c in df.columns if c != "score"]
    held = df.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(batches):
        state["s"] = s = state.get("s") or Scorer(held.value)
        for b in pieces(batches, col):
            at = b.schema.get_field_index(col)
            got = [s.score(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, "score"])

    src = df.select(*(F.col(f"`{c}`") for c in keep))
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType())]))


def labelled(docs: DataFrame, labels: DataFrame, max_docs: int = 40_000) -> DataFrame:
    """text, toxic of about max_docs labelled documents at most, taken by hash of their id. The chosen labels are
    bounded by max_docs, so they are broadcast and no text is shuffled."""
    known = labels.where("toxic is not null").select("doc_id", "toxic")
    part = min(1.0, max_docs / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    channel = fit_channel(docs)
    model = fit_words(labelled(docs.where(~out), labels.where(~out)), channel)
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
