"""The driver contract without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_data_folders(tmp_path):
    """Also while corpus_pipeline.py is still there, which needs them."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".*")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'bm25_topk' in q and set(s) <= set(q) and not [k for k in q if k[:2] == 'op' or k == 'pipeline']"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
