"""The registry works where the training-data folders, or the pipeline with them, are missing."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(set(e.oracle_sql()) - set(q)), *q)"


def told(folder):
    run = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(folder)})
    assert run.returncode == 0, run.stderr[-2000:]
    count, without_query, *names = run.stdout.split()
    return int(count), int(without_query), names


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_folders(tmp_path, pipeline):
    left_out = [".git", "llm", "__pycache__", ".pytest_cache"] + ([] if pipeline else ["corpus_pipeline.py"])
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*left_out))
    count, without_query, names = told(copy)
    from leadlake.plans.jobs import JOBS
    assert sorted(names) == sorted(JOBS) and count == len(JOBS) and without_query == 0


def test_another_missing_module_is_told(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    (copy / "leadlake" / "llm").mkdir()
    (copy / "leadlake" / "llm" / "__init__.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=copy, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(copy)})
    assert run.returncode != 0 and "no_such_module" in run.stderr
