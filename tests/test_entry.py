"""The driver's contract."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_flagship_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["a", "b", "c", "n"] and df.count() > 0


def test_the_rest_stands_alone(tmp_path):
    """Without the optional parts the entry imports and lists the other queries."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".hypothesis", ".pytest_cache")])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pattern_count' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
