"""The driver's entry points, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

from .conftest import ROOT


def test_entry_gives_rows(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["page_id", "url", "page_title", "hit_count"] and rows.count() > 0


def test_every_oracle_has_a_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and entry.catalogue.QUERIES.keys() <= queries.keys()


def test_the_rest_stands_alone(tmp_path):
    """Without loomweb/llm, tests/llm and corpus_pipeline.py the entry imports and keeps its other queries."""
    shutil.copytree(f"{ROOT}/loomweb", tmp_path / "loomweb", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    for with_pipeline in (False, True):
        if with_pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
        assert out.stdout.split() == [str(len(entry.catalogue.QUERIES)), "False", "True"], out.stderr
