"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r.lod for r in rows] == list(range(9)) and rows[0].tiles == 1


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_other_subpackage(tmp_path):
    """The rest imports and lists its queries where the training-data part has been removed."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "r", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ti_complete' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
