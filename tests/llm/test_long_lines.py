"""Operator 5: single lines of many words."""

import pytest

from saleslattice.llm import lines


def test_long_lines(spark):
    long, short = " ".join(f"w{i}" for i in range(6)), "a b c d e"
    rows = [(1, long), (2, long), (3, f"x\n{long}\ny"), (4, short), (5, f"{short}\nz\n  {long}"), (6, f"{long}\nq\n{long}"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.line_dedup(df, long_words=6).collect()}
    assert got == {1: (long, 0), 2: ("", 1), 3: ("x\ny", 1), 4: (short, 0), 5: (f"{short}\nz\n  {long}", 0), 6: ("q", 2), 7: (None, 0)}
    assert {r.doc_id: r.text for r in lines.line_dedup(df).collect()} == dict(rows)
    with pytest.raises(ValueError):
        lines.line_dedup(df, long_words=0)
