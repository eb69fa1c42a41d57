"""Operator 8: long words that fail verification, numerals, and what is forgotten between texts."""

import random
import struct

import pytest

from saleslattice.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation(), t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.mark.parametrize("n", [200, 256, 257, 3000, 1_000_000])
def test_long_words(library, n):
    rnd = random.Random(n)
    word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    c = bpe.Coder(bpe.default_path())
    assert ids(c.encode([word])[0][0]) == library(word) and c.exact == 1


def test_numerals_and_words(library):
    c = bpe.Coder(bpe.default_path())
    texts = ["a½b ½½ x² Ⅷx ٣٤ don't DON'T ''s 'says x's's", "½ a½b", "_a_ a_b ++_++ é_é", "日本語 一二 ﬁ²", "'re'll 'v 't", " x\x85y\x1cz"]
    for _ in range(2):
        assert [ids(a) for a, _ in c.encode(texts)] == [library(t) for t in texts]


def test_forgetting(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "PAIRS", 100)
    rnd = random.Random(3)
    c = bpe.Coder(bpe.default_path())
    for _ in range(30):
        texts = [" ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(1, 9))) for _ in range(20)) for _ in range(5)]
        assert [ids(a) for a, _ in c.encode(texts)] == [library(t) for t in texts]
        assert len(c.young) <= 50 + 100 and len(c.old) <= 50 + 100
