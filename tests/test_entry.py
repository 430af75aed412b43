"""The driver contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_optional_operators(tmp_path):
    shutil.copytree(ROOT / "ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) >= 48


def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["o_custkey", "o_orderkey", "recount", "reported", "reason"]
    assert found.count() > 0
