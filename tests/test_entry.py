import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT, SF


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_imports_without_the_corpus_operators(tmp_path, left):
    gone = {"llm", "corpus_pipeline.py"} - set(left)
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 120 and not any(q.startswith(('op', 'pipeline')) for q in e.queries())"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "r")}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, check=False).returncode == 0


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in ("knn_per_query_top3", "html_sections", "chunk_recursive", "embed_texts"):
    assert e.queries()[name](spark, {SF!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=False, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
