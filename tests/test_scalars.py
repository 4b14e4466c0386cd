import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.errors import InvalidArgument
from trellis.functions import SCALAR, compare, scalar

OPS = ["=", "!=", "<", "<=", ">", ">="]


def results(spark, dtype, left, right):
    """The six operators' results, as a set of those that hold."""
    if dtype == "scalar":
        df, kind = spark.range(1).select((F.lit(None).cast(SCALAR) if left == "missing" else scalar(left)).alias("p")), SCALAR
    else:
        df, kind = spark.createDataFrame([(left,)], f"p {dtype}"), T._parse_datatype_string(dtype)
    row = df.select(*[compare(F.col("p"), kind, op, right).alias(op) for op in OPS]).first()
    assert all(v is not None for v in row)
    return {op for op, v in zip(OPS, row, strict=True) if v}


LESS, EQUAL, MORE, OTHER = {"!=", "<", "<="}, {"=", "<=", ">="}, {"!=", ">", ">="}, {"!="}
VECTORS = [
    (2**53 + 1, float(2**53), MORE), (2**63 - 1, 2.0**63, LESS), (-(2**63), -(2.0**63), EQUAL), (-1, -1.5, MORE), (-2, -1.5, LESS), (1, 1.0, EQUAL), (2**53, float(2**53), EQUAL), (5, 5.5, LESS), (0, -1e300, MORE), (0, 1e300, LESS), (0, -0.0, EQUAL),
    ("a", "b", LESS), ("10", "2", LESS), ("é", "z", MORE), ("a", "a", EQUAL), (True, True, {"="}), (True, False, OTHER), (True, 1, OTHER), (1, True, OTHER), ("1", 1, OTHER), (None, None, {"="}), (None, 1, OTHER), (1, None, OTHER),
]


def flipped(s):
    return {{"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op) for op in s}


@pytest.mark.parametrize("left,right,want", VECTORS)
def test_vectors(spark, left, right, want):
    assert results(spark, "scalar", left, right) == want
    assert results(spark, "scalar", right, left) == flipped(want)
    plain = {bool: "boolean", int: "long", float: "double", str: "string"}
    for a, b, w in ((left, right, want), (right, left, flipped(want))):
        if a is not None:
            assert results(spark, plain[type(a)], a, b) == w


def test_missing_passes_only_unequal(spark):
    for value in (None, 1, "x", True, 1.5):
        assert results(spark, "scalar", "missing", value) == {"!="}
        assert results(spark, "long", None, value) == {"!="}


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), 2**63, [1], {"a": 1}])
def test_values_that_are_no_properties(spark, bad):
    with pytest.raises(InvalidArgument):
        compare(F.lit(1), T.LongType(), "=", bad)


def test_comparisons_reach_the_scan(spark, sf):
    from trellis.operators import find_nodes
    from trellis.sources import star_graph

    df = find_nodes(star_graph(spark, sf), "Part", ("retailprice", ">=", 1000), None, ["id", "retailprice"])
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(p_retailprice,1000.0)" in plan and "p_brand" not in plan.split("Physical Plan")[1]
