"""The entry module with and without what its optional part needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; from workload import QUERIES; q = e.queries(); print(set(QUERIES) <= set(q), len(q) - len(QUERIES))"


@pytest.mark.parametrize("hidden", ["public_tokenizers", "tokenizers", "zstandard", "corpus_pipeline", "aerospark.llm"])
def test_other_queries_stay_where_a_module_is_missing(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; {COUNT}"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert found.stdout.split() == ["True", "0"], found.stderr


def test_other_errors_are_not_hidden(tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("raise RuntimeError('broken')\n")
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.path.insert(0, {str(tmp_path)!r}); import corpus_pipeline"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "broken" in found.stderr and found.returncode
