import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.predicate import PredicateError, predicate
from weftline.functions.values import find_field, geometry_field, invariant_text, lenient, parse_datetime
from weftline.sources.inference import CATALOG, PLAIN, infer


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], T.StructType([T.StructField("v", T._parse_datatype_string(kind))]))


@pytest.mark.parametrize(("text", "kind", "want"), [("1,234.5", "double", 1234.5), ("x", "double", 0.0), (" 7 ", "int", 7), ("7.5", "bigint", 0), ("99999999999", "int", 0), (" TRUE ", "boolean", True), ("yes", "boolean", False), ("1", "boolean", False), (None, "int", 0), ("", "double", 0.0), ("1e3", "double", 1000.0)])
def test_lenient(spark, text, kind, want):
    assert one(spark, text).select(lenient(F.col("v"), T._parse_datatype_string(kind))).first()[0] == want


@pytest.mark.parametrize(("value", "want"), [(20.0, "20"), (6.666666666666667, "6.666666666666667"), (1e20, "1E+20"), (1e-5, "1E-05"), (12345678.5, "12345678.5"), (1e7, "10000000"), (0.0005, "0.0005"), (-2.5e-7, "-2.5E-07"), (1.5e15, "1.5E+15"), (0.0, "0"), (None, "")])
def test_number_text(spark, value, want):
    df = one(spark, value, "double")
    assert df.select(invariant_text(F.col("v"), df.schema["v"])).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("2026-07-08T12:00:00Z", "2026-07-08 12:00:00"), ("2026-07-08 12:00", "2026-07-08 12:00:00"), ("07/08/2026", "2026-07-08 00:00:00"), ("2026-07-08T12:00:00+02:00", "2026-07-08 10:00:00"), ("soon", None), ("", None)])
def test_datetime(spark, text, want):
    assert one(spark, text).select(parse_datetime(F.col("v")).cast("string")).first()[0] == want


def test_fields():
    s = T.StructType([T.StructField("id", T.LongType()), T.StructField("geom", T.BinaryType(), True, {"geometry": True}), T.StructField("name", T.StringType())])
    assert geometry_field(s).name == "geom" and find_field(s, "NAME").name == "name"
    with pytest.raises(ValueError, match="missing"):
        find_field(s, "missing")


def test_inference():
    assert infer(["1", "2", ""], PLAIN) == T.LongType()
    assert infer(["12.5", "8"], PLAIN) == T.DoubleType()
    assert infer(["true", "False"], PLAIN) == T.BooleanType()
    assert infer(["", None], PLAIN) == T.StringType()
    assert infer(["1", "2"], CATALOG) == T.IntegerType()
    assert infer(["1", "5000000000"], CATALOG) == T.LongType()


ROWS = [(1, True, "active"), (2, False, "inactive"), (3, True, "archived")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('(isActive == true && status startsWith "act") || id == 2', [1, 2]),
        ('(isActive == true && status startsWith "act") || (!isActive == true && id == 2)', [1, 2]),
        ("id > 1 && id <= 3", [2, 3]),
        ("status == ACTIVE", [1]),
        ("status contains 'CHIV'", [3]),
        ("status matches '^(in)?act'", [1, 2]),
        ("status endsWith ed", [3]),
        ('!(status == "active" || id == 3)', [2]),
        ("status != 'a (b) || c'", [1, 2, 3]),
    ],
)
def test_predicate(spark, text, want):
    df = spark.createDataFrame(ROWS, "id long, isActive boolean, status string")
    assert sorted(r.id for r in df.where(predicate(text, df.schema)).collect()) == want


@pytest.mark.parametrize("text", ["missing == 1", "id == x", "isActive > true", "status > a", "id ==", "(id == 1", "id == 1 id == 2", "", "id contains 1", "isActive == maybe", "status == 'a"])
def test_predicate_errors(spark, text):
    df = spark.createDataFrame(ROWS, "id long, isActive boolean, status string")
    with pytest.raises(PredicateError):
        predicate(text, df.schema)


def test_predicate_nulls_are_false(spark):
    df = spark.createDataFrame([(None, None), (1, "a")], "id long, s string")
    assert df.where(predicate("id != 5 && s != b", df.schema)).count() == 1
    assert df.where(predicate("!id == 1", df.schema)).count() == 1


def test_predicate_random(spark):
    rng = random.Random(42)
    rows = [(rng.randint(-100, 100), rng.uniform(-100, 100)) for _ in range(200)]
    df = spark.createDataFrame(rows, "id long, score double").cache()
    cuts = [rng.randint(-100, 100) for _ in range(50)]
    got = df.select(*[F.sum(predicate(f"id >= {t}", df.schema).cast("int")) for t in cuts]).first()
    assert list(got) == [sum(i >= t for i, _ in rows) for t in cuts]


def _oracle(text, row):
    """A short evaluator of the grammar by Python's own."""
    names = {"id": row[0], "s": row[1]}
    out = re.sub(r"(id|s) (==|!=|>=|<=|>|<|contains) (\"[^\"]*\"|-?\d+)", lambda m: str(bool(_cond(names[m[1]], m[2], m[3].strip('"')))), text)
    return eval(out.replace("&&", " and ").replace("||", " or ").replace("!", " not "))  # noqa: S307


def _cond(x, op, v):
    if isinstance(x, str):
        x, v = x.lower(), v.lower()
        return {"==": x == v, "!=": x != v, "contains": v in x}[op]
    v = float(v)
    return {"==": x == v, "!=": x != v, ">=": x >= v, "<=": x <= v, ">": x > v, "<": x < v}[op]


CONDITION = st.one_of(st.tuples(st.just("id"), st.sampled_from(["==", "!=", ">=", "<=", ">", "<"]), st.integers(-5, 5).map(str)), st.tuples(st.just("s"), st.sampled_from(["==", "!=", "contains"]), st.sampled_from(["a", "AB", "b c"]).map(lambda x: f'"{x}"'))).map(" ".join)
TREE = st.recursive(CONDITION, lambda inner: st.one_of(st.tuples(inner, st.sampled_from([" && ", " || "]), inner).map(lambda t: f"({''.join(t)})"), inner.map(lambda x: f"!({x})")), max_leaves=5)
POINTS = [(i, s) for i in (-5, -1, 0, 3) for s in ("a", "ab", "b c", "")]


@settings(max_examples=25, deadline=None)
@given(TREE)
def test_predicate_property(spark, text):
    df = spark.createDataFrame(POINTS, "id long, s string").coalesce(1)
    assert [tuple(r) for r in df.where(predicate(text, df.schema)).collect()] == [p for p in POINTS if _oracle(text, p)]
