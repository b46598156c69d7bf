import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("vecloom/llm", "tests/llm"), ("vecloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    for path in gone:
        shutil.rmtree(copy / path, ignore_errors=True) if path != "corpus_pipeline.py" else (copy / path).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not [n for n in q if n[:2] == 'op' or n == 'pipeline']"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
