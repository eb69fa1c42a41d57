"""Components of links against union-find."""

import random

import pytest

from saleslattice.llm import forest


def plain(links):
    up = {i: i for p in links for i in p}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {i: top(i) for i in up}


@pytest.fixture
def made(monkeypatch):
    """What components() writes: two tables, and two more a round."""
    made, write = [], forest.checkpointed
    monkeypatch.setattr(forest, "checkpointed", lambda df: made.append(df) or write(df))
    return made


@pytest.mark.parametrize("held", [1 << 16, 200])
def test_links_are_contracted_by_their_tasks(spark, monkeypatch, made, held):
    """Pieces of six chains in different orders, as neighbours in six trees give them, and a path."""
    monkeypatch.setattr(forest, "LINKS", held, raising=False)
    rnd = random.Random(3)
    ids = rnd.sample(range(-(10**12), 10**12), 2500)
    links = [p for _ in range(6) for x in [rnd.sample(ids, len(ids))] for p in zip(x, x[1:], strict=False) if rnd.random() < 0.4]
    links += [(10**13, 10**13 + 1), (10**13 + 5, 10**13 + 4), (10**13 + 4, 10**13 + 5)]
    got = {r.id: r.comp for r in forest.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain(links)
    assert len(made) <= 6 or held < len(links)
    path = [10**14 + i for i in rnd.sample(range(200), 200)]
    more = [(ids[0], 10**13), (10**13 + 1, 10**13 + 4), *zip(path, path[1:], strict=False)]
    again = forest.components(spark.createDataFrame(more, "a long, b long"), spark.createDataFrame(list(got.items()), "id long, comp long"))
    assert {r.id: r.comp for r in again.collect()} == plain(links + more)


def test_no_links(spark):
    assert forest.components(spark.createDataFrame([], "a long, b long")).count() == 0
