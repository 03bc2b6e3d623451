import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_and_tests_work_without_the_corpus_folders(tmp_path, gone):
    copy = tmp_path / "r"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    code = """
import __spark_entry__ as e
from larkspur.session import build_session
names = e.queries()
assert not [n for n in names if n.startswith("op") or n == "pipeline"] and len(names) > 90, names
spark = build_session("local[2]", 2)
assert e.entry(spark).count() > 0 and names["trigger_audit"](spark, "/root/testdata/sf0.001").count() == 5
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy)
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "tests/engine/test_filters.py", "tests/engine/test_scalars.py"], check=True, cwd=copy)
