"""The native operators run no Python, and no operator's plan crosses its inputs."""

import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.test_plans import plan
from weftline import llm

PYTHON = ("PythonUDF", "MapInPandas", "ArrowEvalPython")


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_secret_scan", "op7_decontamination"])
def test_native_operators(spark, name):
    text = plan(llm.queries()[name](spark, SF))
    assert not any(x in text for x in (*PYTHON, "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("name", ["op3_language_id", "op4_packing", "op9_license_scan"])
def test_one_pass_operators(spark, name):
    """Their last step reads documents once and shuffles nothing."""
    text = plan(llm.queries()[name](spark, SF))
    assert "Exchange" not in text and text.count("Scan parquet") == 2  # the tree and its details


def test_language_is_scored_once(spark):
    """The filter on the score does not make a second copy of its call."""
    text = plan(corpus_pipeline.language_id(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF))
    assert text.count("ArrowEvalPython") == 2  # the tree and its details


def test_token_files_are_read_by_one_python_step(spark):
    """Each Python step of a stage has a worker of its own in every task, and executors' memory is bounded."""
    text = plan(llm.queries()["op1_token_binary"](spark, SF))
    assert text.count("MapInPandas") == 2 and "ArrowEvalPython" not in text  # the tree and its details
