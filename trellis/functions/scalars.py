"""Property values and their comparison.

A property is a column of a label's table. Where all nodes give it one type the column has that
Spark type and null means that the node lacks it. Where types mix it is a SCALAR struct: a tag and
a field per type, so that 1 and 1.0 stay apart and a null value differs from a missing one."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument

SCALAR = T.StructType(
    [T.StructField("t", T.StringType()), T.StructField("b", T.BooleanType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())]
)
OPERATORS = ("=", "==", "!=", "<", "<=", ">", ">=")
_FIELDS = {"bool": "b", "int": "i", "double": "d", "string": "s"}
_LEAST, _BEYOND = -(2**63), 2**63


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        if not _LEAST <= value < _BEYOND:
            raise InvalidArgument(f"{value} does not fit 64 bits")
        return "int"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise InvalidArgument("a number must be finite")
        return "double"
    if isinstance(value, str):
        return "string"
    raise InvalidArgument(f"{type(value).__name__} is not a property type")


def scalar(value: Any) -> Column:
    """The SCALAR of a Python value."""
    kind = kind_of(value)
    field = _FIELDS.get(kind)
    return F.struct(F.lit(kind).alias("t"), *[(F.lit(value) if f.name == field else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCALAR.fields[1:]])


def property_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(dtype, T.FloatType | T.DoubleType):
        return "double"
    if isinstance(dtype, T.StringType):
        return "string"
    raise InvalidArgument(f"{dtype.simpleString()} is not a property type")


def _apply(c: Column, op: str, value: Any) -> Column:
    return {"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]


def _integers(c: Column, op: str, value: float) -> Column:
    """64-bit integers against a double, exactly: the double becomes the next integer."""
    if op == "=":
        return _apply(c, "=", int(value)) if value.is_integer() and _LEAST <= value < _BEYOND else F.lit(False)
    if value >= _BEYOND or value < _LEAST:
        return c.isNotNull() if (op[0] == "<") == (value > 0) else F.lit(False)
    whole = math.ceil(value) if op in ("<", ">=") else math.floor(value)
    if whole >= _BEYOND:
        return c.isNotNull() if op == "<" else F.lit(False)
    return _apply(c, op, whole)


def _doubles(c: Column, op: str, value: int) -> Column:
    """Doubles against a 64-bit integer, exactly: the integer becomes the nearest double."""
    near = float(value)
    if int(near) == value:
        return _apply(c, op, near)
    if op == "=":
        return F.lit(False)
    above = int(near) > value  # no double lies between value and near
    return _apply(c, {"<": "<" if above else "<=", ">": ">=" if above else ">"}[op[0]], near)


def _same_kind(c: Column, kind: str, op: str, value: Any) -> Column | None:
    """c (a plain column of that kind) op value, or None if the types never compare."""
    other = kind_of(value)
    if kind == "int" and other == "double":
        return _integers(c, op, value)
    if kind == "double" and other == "int":
        return _doubles(c, op, value)
    if kind != other or (kind == "bool" and op != "="):
        return None
    return _apply(c, op, value)


def passes(c: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    """A filter on a property: true where it passes, false or null where it doesn't. On plain
    columns it is a comparison with a literal of the column's type, which scans push down."""
    if op not in OPERATORS:
        raise InvalidArgument(f"unknown operator {op}")
    if op == "!=":
        return ~compare(c, dtype, "=", value)
    op = "=" if op == "==" else op
    if isinstance(dtype, T.StructType):
        if value is None:
            return (c["t"] == "null") if op == "=" else F.lit(False)
        found = F.lit(False)
        for kind, field in _FIELDS.items():
            one = _same_kind(c[field], kind, op, value)
            if one is not None:
                found = found | ((c["t"] == kind) & one)
        return found
    kind_of(value)
    one = None if value is None else _same_kind(c, property_kind(dtype), op, value)
    return F.lit(False) if one is None else one


def compare(c: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    """As passes, but false in place of null: a missing property passes only !=."""
    if op == "!=":
        return ~compare(c, dtype, "=", value)
    return F.coalesce(passes(c, dtype, op, value), F.lit(False))
