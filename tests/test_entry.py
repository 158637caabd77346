"""The driver contract with and without the corpus subpackage."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["zstandard", "lectern.llm", "corpus_pipeline"])
def test_other_queries_stay_if_something_cannot_be_imported(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; print(len(e.queries()), sum(q[:2] == 'op' or q == 'pipeline' for q in e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= 113 and said[1] == "0" and int(said[2]) >= 112


def test_names_of_queries_and_sql_agree():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
