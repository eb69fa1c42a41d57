"""What tasks remember is bounded by letters: many long words don't grow a worker."""

import random
import tracemalloc

from saleslattice.llm import bpe, toxicity


def words(n, letters, seed):
    rng = random.Random(seed)
    part = ["".join(rng.choice("abcdefgh") for _ in range(50)) for _ in range(300)]
    return ["".join(rng.choice(part) for _ in range(letters // 50)) for _ in range(n)]


def test_long_words_of_bpe(monkeypatch):
    monkeypatch.setattr(bpe, "LETTERS", 30_000)
    made = bpe.Coder(bpe.default_path())
    want = {}
    for k in range(4):
        some = words(10, 2000, k)
        want |= dict(zip(some, made.encode(some), strict=True))
        assert made.letters <= 30_000 + 10 * 2000 and len(made.young) <= 30
    assert sum(map(len, made.old)) + made.letters <= 100_000
    fresh = bpe.Coder(bpe.default_path())
    assert [fresh.encode([w])[0] for w in list(want)[:5]] == [want[w] for w in list(want)[:5]]


def test_long_tokens_of_toxicity(monkeypatch):
    monkeypatch.setattr(toxicity, "LETTERS", 20_000)
    scorer = toxicity.Scorer({"weights": {"bad": 0.9}, "prior": 0.1, "channel": {}, "steps": ()})
    tracemalloc.start()
    for k in range(10):
        scorer.score(" ".join(words(10, 1000, k)))
    now = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert scorer.letters <= 20_000 + 1000 and scorer.restorer.letters <= 20_000 + 1000 and len(scorer.known) < 40 and now < 5e6


def test_empty_tables(spark):
    """No rows in, no rows out, with the columns and their types."""
    none = spark.createDataFrame([], "doc_id long, text string, score string, ids string")
    model = {"weights": {}, "prior": 0.0, "channel": {}, "steps": ()}
    scored = toxicity.score(none, model)
    assert scored.count() == 0 and dict(scored.dtypes)["score"] == "double"
    coded = bpe.encode(none)
    assert coded.count() == 0 and coded.columns == ["doc_id", "n_tokens", "ids", "decoded"]
