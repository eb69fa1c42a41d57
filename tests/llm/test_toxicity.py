"""Operator 6: restored words and held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from saleslattice.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    r = toxicity.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    right = sum(a == b for a, b in r) / len(r)
    assert len(r) > 50 and right > 0.93, right


def test_restored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ch = toxicity.fit_channel(docs)
    r = toxicity.Restorer(toxicity.Channel(ch, ("idiot", "loser", "scum", "moron", "stupid", "clown")))
    for seen, word in (("1d10t!", "idiot"), ("l00ooser", "loser"), ("s.c.u.m", "scum"), ("m o r o n", "moron"), ("$tup1d", "stupid"), ("CLOWN!!", "clown"), ("stuuuupid", "stupid"), ("y o u s c u m", "scum")):
        assert word in r.words(f"the {seen} of"), (seen, r.words(f"the {seen} of"))
    plain = r.words("The old, man's 3.14 don't 1984 a | b | c")
    assert {"the", "old", "a", "b"} <= plain


def test_edges(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate([("you idiot", 1), ("nice day", 0), (None, 0), ("", 1), ("w " * 50_000, 0)] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit("x"))
    m = toxicity.fit_words(df, toxicity.fit_channel(df))
    got = toxicity.score(df, m)
    assert got.count() == 40 and got.where("score between 0 and 1").count() == 40 and got.columns == ["doc_id", "text", "toxic", "score"]
    assert toxicity.score(df, toxicity.fit_words(df.limit(0), {})).where("score = 0").count() == 40


def brute_decode(channel, text, spaced):
    """Every way to read each character, with the likelihood of the whole."""
    found = []

    def go(i, a, b, p, out):
        if i == len(text):
            found.append((p + channel.table[a][b][0], out))
            return
        ch = text[i]
        if ch in toxicity.GAPS or ch == " ":
            go(i + 1, a, b, p - 0.2, out)
        elif i and ch == text[i - 1] and ch.isalpha():
            go(i + 1, a, b, p - 0.5, out)
        elif not ch.isalpha():
            go(i + 1, a, b, p - 3.0, out)
        for x in (ch,) if ch.isalpha() else toxicity.LEET.get(ch, ""):
            k, cost = (ord(x) - 96 if "a" <= x <= "z" else 27), 0.0 if x == ch else -1.0
            go(i + 1, b, k, p + cost + channel.table[a][b][k], out + x)
            if spaced and b:
                go(i + 1, 0, k, p + cost - 1.0 + channel.table[a][b][0] + channel.table[b][0][k], out + " " + x)

    go(0, 0, 0, 0.0, "")
    return max(found)[1]


@pytest.mark.parametrize("spaced", [False, True])
def test_decoder_against_enumeration(spaced):
    rnd = random.Random(spaced)
    channel = toxicity.Channel({rnd.randrange(28**3): rnd.randrange(1, 1000) for _ in range(3000)}, ("scum", "idiot"))
    for _ in range(300):
        text = "".join(rnd.choice("abcdiosté0134@$!|.- ?") * rnd.choice((1, 1, 1, 2)) for _ in range(rnd.randrange(1, 7)))[:8]
        assert channel.decode(text, spaced) == brute_decode(channel, text, spaced), text


def test_long_tokens():
    channel = toxicity.Channel({})
    words = toxicity.Restorer(channel).words(f"{'a1' * 100_000} {'s ' * 50_000} end")
    assert "end" in words and max(map(len, words)) >= 100_000


def test_scores_against_brute_force(spark):
    """Weights and scores of a corpus of plain words, counted by hand."""
    rnd = random.Random(8)
    plain, marked = [f"w{'abcdefghij'[i]}{'klmnopqrst'[j]}" for i in range(10) for j in range(10)], ["vile", "nasty"]
    rows = []
    for k in range(600):
        toxic = int(k % 5 == 0)
        rows.append((k, " ".join(rnd.sample(plain, 8) + ([rnd.choice(marked)] if toxic else [])), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_words(df, {})
    half = df.withColumn("h", F.pmod(F.shiftright(F.xxhash64("text"), 20), F.lit(2))).collect()
    fit = [(set(r.text.split()), r.toxic) for r in half if r.h == 0]
    prior = sum(t for _, t in fit) / len(fit)
    want = {}
    for f in {f for ws, _ in fit for w in ws for f in toxicity.features(w)}:
        n = [t for ws, t in fit if any(f in toxicity.features(w) for w in ws)]
        p = (sum(n) + 10 * prior) / (len(n) + 10)
        if sum(n) >= 5 and p >= max(0.25, 2 * prior) and (sum(n) - len(n) * prior) / (len(n) * prior * (1 - prior)) ** 0.5 >= 5:
            want[f] = p
    assert model["weights"].keys() == want.keys() >= {"vile", "nasty"} and all(abs(model["weights"][f] - p) < 1e-9 for f, p in want.items())
    raw = {r.doc_id: r.score for r in toxicity.score(df, model | {"steps": ()}).collect()}
    for k, text, _ in rows:
        best = [max(want.get(f, 0.0) for f in toxicity.features(w)) for w in set(text.split())]
        assert abs(raw[k] - toxicity.together(best, prior * 0.2)) < 1e-9
    seen = sorted((raw[r.doc_id], r.toxic) for r in half if r.h == 1)
    assert model["steps"] == toxicity.steps(seen, prior)
    assert [p for _, p in model["steps"]] == sorted(p for _, p in model["steps"])
    final = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for k, x in raw.items():
        under = [p for at, p in model["steps"] if at <= x]
        assert abs(final[k] - (under[-1] if under else model["steps"][0][1])) < 1e-5
