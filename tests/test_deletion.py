"""The library and its entry points work without the training-data subpackage and its tests."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
CALL = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(o) <= set(q); print(sorted(k for k in q if k[:2] == 'op' or k == 'pipeline'))"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_without_the_training_data_folders(tmp_path, also):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", *also)
    shutil.copytree(HERE, tmp_path / "repo", ignore=skip)
    run = subprocess.run([sys.executable, "-c", CALL], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert run.returncode == 0 and run.stdout.strip() == "[]", run.stderr


def test_nothing_else_imports_the_subpackage():
    rest = [p for p in (HERE / "citeloom").rglob("*.py") if "llm" not in p.relative_to(HERE / "citeloom").parts]
    assert rest and not any("citeloom.llm" in p.read_text() for p in rest)
