"""Physical plans: what reaches the scan, and what stays out of the plan."""

import contextlib
import io

import pytest

from weftline import queries as q
from weftline.queries import apply, table

from .conftest import SF


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    df = apply(spark, "TransformFilter", table(spark, SF, "lineitem"), when="l_quantity > 40 && l_orderkey <= 100")
    text = plan(apply(spark, "TransformSchemaMapper", df, fields="l_orderkey,l_quantity"))
    assert "GreaterThan(l_quantity,40.0)" in text and "LessThanOrEqual(l_orderkey,100)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_flagship_is_one_shuffle_of_partial_sums(spark):
    text = plan(q.flagship(spark, SF))
    assert text.split("== Physical Plan ==")[1].split("(1)")[0].count("Exchange") == 1 and "partial_sum" in text and "Python" not in text


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - {"csv_round_trip", "json_round_trip", "excel_round_trip", "geojson_round_trip"}))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(q.QUERIES[name](spark, SF))
    assert not any(x in text for x in ("PythonUDF", "MapInPandas", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"))
