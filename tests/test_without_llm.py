"""The rest works without the training-data subpackage, with or without the pipeline beside it."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'strong_alignment' in q and set(o) <= set(q); print([x for x in q if x == 'pipeline' or x[:2] == 'op' and x[2].isdigit()])"


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("leave_folder", [True, False])
def test_queries_without_the_subpackage(tmp_path, pipeline, leave_folder):
    shutil.copytree(os.path.join(ROOT, "placeloom"), tmp_path / "placeloom", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    if leave_folder:
        (tmp_path / "placeloom" / "llm").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and run.stdout.strip() == "[]", run.stderr
