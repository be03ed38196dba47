"""The entry module without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_operators(tmp_path, pipeline):
    """It imports and runs the flagship query when their folders are gone, whether the pipeline's file is there or not."""
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", "llm")])
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert not [k for k in e.queries() if k == "pipeline" or k[:2] == "op" and k[2].isdigit()] and e.queries() and e.oracle_sql()
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.entry(spark).count())
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
    assert "ROWS" in said.stdout, said.stderr[-2000:]
