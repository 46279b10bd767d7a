"""The rest of the library stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert not [n for n in names if n.startswith('op') or n == 'pipeline'], names
assert set(e.oracle_sql()) <= names
print(len(names))
"""


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_queries_without_the_subpackage(tmp_path, with_pipeline):
    shutil.copytree(os.path.join(ROOT, "quarry"), tmp_path / "quarry", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if with_pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 80
