"""The driver's contract, with and without the training-data operators."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_subpackage():
    code = "import sys; sys.modules['lorewell.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
