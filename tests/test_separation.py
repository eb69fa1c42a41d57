"""The sales queries work on a copy without the training-data operators, with or without the pipeline's file."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).parent.parent
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "pivot_groupby" in names and set(e.oracle_sql()) <= names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_llm(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *(() if pipeline else ("corpus_pipeline.py",))))
    assert not (copy / "saleslattice" / "llm").exists()
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
