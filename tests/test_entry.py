"""The driver's entry works with and without the corpus operators, and from any working folder."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("maskwright.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
"""
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def _run(code):
    env = os.environ | {"PYTHONPATH": ROOT}
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, cwd="/tmp", check=True).stdout.split()


def test_without_the_corpus_operators():
    n, ops, pipeline = _run(WITHOUT + SHOW)
    assert int(n) > 100 and ops == "0" and pipeline == "False"


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/maskwright/llm"), reason="the corpus operators are not here")
def test_with_them():
    n, ops, pipeline = _run(SHOW)
    assert int(n) > 110 and ops == "13" and pipeline == "True"
