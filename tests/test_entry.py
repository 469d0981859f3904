"""The entry module without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("left_over", [True, False])
def test_import_without_subpackage(tmp_path, pipeline, left_over):
    """Neither a pipeline file nor an empty folder that stays behind is in the way."""
    shutil.copytree(REPO / "registry", tmp_path / "registry")
    shutil.copytree(REPO / "trackline", tmp_path / "trackline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if pipeline and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    if left_over:
        (tmp_path / "trackline" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert len(names) >= 60 and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
