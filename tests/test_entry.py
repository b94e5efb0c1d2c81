"""The driver contract with and without the removable parts."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
REMOVABLE = {
    "folders": ["rxncurate/llm", "tests/llm"],
    "folders and pipeline": ["rxncurate/llm", "tests/llm", "corpus_pipeline.py"],
}


@pytest.mark.parametrize("case", sorted(REMOVABLE))
def test_entry_without_removable_parts(tmp_path, case):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for part in REMOVABLE[case]:
        path = copy / part
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print('pipeline' in q, len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert run.stdout.split()[0] == "False" and int(run.stdout.split()[1]) > 40


def test_every_statement_has_a_query():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); assert callable(e.entry)"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
