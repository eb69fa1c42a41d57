"""Language ID by rank-order profiles (out-of-place distance).

``fit(labelled)`` counts letter n-grams (1 to 3 bytes of lower-cased words) over every labelled text and keeps each
language's most frequent ones in order. ``predict(df, profiles)`` ranks all n-grams of a whole text by frequency and
sums, over its ``OF_TEXT`` most frequent, how far each is out of place in a language's profile; one that the profile
lacks is ``PROFILE`` places away. The nearest language wins. The score is 1 where the text ranks as the profile does and
0 where none of its n-grams is in the profile. Of n-grams of one frequency the lesser code comes first, in texts and
profiles.

Null, empty and letterless texts get ``und`` and score 0. Ties go to the first language in text order. Rows with a null
label are not learnt from. With no labelled rows every text is ``und``. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import pieces

PROFILE, OF_TEXT, GRAMS = 400, 300, 3
#: Parts of a language's n-grams that are ranked apart before they are ranked together; counts that a task holds.
PARTS, HELD = 16, 1 << 20
#: Bytes of a long text that are counted at a time.
SLICE = 1 << 20
#: Symbols: 0 no letter, 1 to 26 the letters a to z, then the bytes from 128 on.
SYMBOLS = 27 + 128
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = np.arange(27, SYMBOLS)
#: Bits of an n-gram's code, its length (in the last two) included.
WIDTH = int(SYMBOLS**GRAMS * 4).bit_length()
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def _grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of lower-case texts, and each one's text. Blanks stand before, between and after words; an
    n-gram has a letter, a blank only at its ends."""
    return _coded(_CODE[np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)], np.repeat(np.arange(len(raws)), [len(r) + 1 for r in raws]))


def _coded(s: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that start at the first symbols, as many as of has, and what of says of them."""
    two = s[:-1] * SYMBOLS + s[1:]
    codes, texts = [], []
    for n, g, ok in ((1, s, s > 0), (2, two, (s[:-1] > 0) | (s[1:] > 0)), (3, two[:-1] * SYMBOLS + s[2:], s[1:-1] > 0)):
        at = np.flatnonzero(ok[: len(of)])
        codes.append(g[at] * 4 + n)
        texts.append(of[at])
    return np.concatenate(codes), np.concatenate(texts)


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each comes (n: counts to add up)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[at], np.diff(np.append(at, len(keys))) if n is None else np.add.reduceat(n, at) if len(at) else n


def _tallied(raws: list[bytes], base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts, each with its text's number (or base of it) in front, and counts. A long text is taken in
    slices, so that only its distinct n-grams are held."""
    base = np.arange(len(raws)) if base is None else base
    if len(raws) != 1 or len(raws[0]) <= SLICE:
        codes, of = _grams(raws)
        return _counted(base[of] << WIDTH | codes)
    data = np.frombuffer(b" " + raws[0] + b" ", np.uint8)
    keys = n = np.zeros(0, np.int64)
    for at in range(0, len(data) - 1, SLICE):
        here = min(SLICE, len(data) - 1 - at)
        k, m = _counted(_coded(_CODE[data[at : at + here + 2]], np.zeros(here, np.int64))[0])
        keys, n = _counted(np.concatenate([keys, k]), np.concatenate([n, m]))
    return base[0] << WIDTH | keys, n


def _lowered(batch: pa.RecordBatch, name: str) -> tuple[list[str], list[bytes]]:
    texts = [(t or "").lower() for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
    return texts, [t.encode() for t in texts]


def _count(batches):
    langs: dict[str, int] = {}
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def summed():
        return _counted(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

    def flush(keys, n):
        names = np.array(list(langs), object)[keys >> WIDTH] if len(keys) else []
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys & ((1 << WIDTH) - 1)), pa.array(n)], names=["lang", "gram", "n"])

    for b in pieces(batches, "text", 1 << 20):
        lang = np.array([langs.setdefault(x, len(langs)) for x in b.column(b.schema.get_field_index("lang")).to_pylist()], np.int64)
        held.append(_tallied(_lowered(b, "text")[1], lang))
        if sum(len(k) for k, _ in held) > HELD:
            held[:] = [summed()]
            if len(held[0][0]) > HELD // 2:
                yield flush(*held[0])
                held[:] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    yield flush(*summed())


def fit(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's ``size`` most frequent n-grams, most frequent first; at most size times languages reach the driver."""
    counts = labelled.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))

    def first(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)

    out: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(((r.lang, r.gram, r.r) for r in first(first(parts, "lang", "part").drop("r"), "lang").collect()), key=lambda x: (x[0], x[2])):
        out.setdefault(lang, []).append(gram)
    return out


class Ranker:
    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.known = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        #: Rank of each known n-gram by language, PROFILE where the profile lacks it; the last column is for all others.
        self.ranks = np.full((len(self.langs), len(self.known) + 1), PROFILE, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))

    def of(self, batch: pa.RecordBatch, name: str) -> tuple[list[str], list[float]]:
        texts, raws = _lowered(batch, name)
        d = len(texts)
        keys, n = _tallied(raws)
        # in order of text, falling frequency and code: one sort of all three in one number
        most, span = int(n.max(initial=0)), 1 << WIDTH
        keys = np.sort(((keys >> WIDTH) * (most + 1) + most - n) * span + (keys & (span - 1)))
        row, gram = keys // (span * (most + 1)), keys & (span - 1)
        rank = np.arange(len(keys)) - np.searchsorted(row, np.arange(d))[row]
        top = np.flatnonzero(rank < OF_TEXT)
        row, gram, rank = row[top], gram[top], rank[top]
        at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        at[self.known[at] != gram] = len(self.known)
        far = np.empty((d, len(self.langs)))
        for k, ranks in enumerate(self.ranks):
            place = ranks[at]
            far[:, k] = np.bincount(row, np.where(place == PROFILE, PROFILE, np.minimum(np.abs(place - rank), PROFILE)), d)
        best = far.argmin(1)
        total = np.bincount(row, minlength=d)
        letter = np.fromiter(map(has_letter, texts), bool, d)
        score = np.where(letter & (total > 0), 1 - far[np.arange(d), best] / np.maximum(total * PROFILE, 1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)], score.clip(0, 1).tolist()


def predict(df: DataFrame, profiles: dict[str, list[int]], col: str = "text") -> DataFrame:
    """df's rows and columns with lang_pred and score (df's columns of these names are replaced)."""
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    made = df.sparkSession.sparkContext.broadcast(profiles)
    state: dict = {}

    def run(batches):
        if profiles_of := made.value:
            state["r"] = state.get("r") or Ranker(profiles_of)
        for b in pieces(batches, col, 1 << 20):
            pred, score = state["r"].of(b, col) if profiles_of else (["und"] * b.num_rows, [0.0] * b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    src = df.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    profiles = fit(docs.where(~out))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")
