"""Filters of the document model as Columns.

A filter is a dict of field: value (equality) or field: {operator: operand}; all parts must hold. A field that is missing or null
fails every operator, $ne and $nin too.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import compare, equals

ORDER = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


def _operator(col: Column, kind: T.DataType, op: str, operand: Any) -> Column:
    if op == "$eq":
        return equals(col, kind, operand)
    if op == "$ne":
        return col.isNotNull() & ~F.coalesce(equals(col, kind, operand), F.lit(False))
    if op in ORDER:
        return compare(col, kind, ORDER[op], operand)
    if op in ("$in", "$nin"):
        if not isinstance(operand, (list, tuple, set)):
            return col.isNotNull()  # no constraint
        values = [v for v in operand if v is not None]
        simple = [v for v in values if not isinstance(v, (list, tuple, dict, bool)) and isinstance(v, str) == isinstance(kind, T.StringType)]
        plain = isinstance(kind, (T.StringType, T.NumericType))
        if plain:
            found = col.isin(simple) if simple else F.lit(False)
        else:
            found = reduce(lambda a, b: a | b, (equals(col, kind, v) for v in values), F.lit(False))
        return found if op == "$in" else col.isNotNull() & ~found
    raise ValueError(f"unknown operator {op}")


def matches(spec: dict[str, Any] | None, schema: T.StructType) -> Column:
    """A filter as a Column over rows of the schema. None or {} holds for every row. Unknown operators raise ValueError."""
    parts = []
    for field, want in (spec or {}).items():
        operators = isinstance(want, dict) and bool(want) and all(k.startswith("$") for k in want)
        for op, operand in want.items() if operators else [("$eq", want)]:
            if field not in schema.names:
                _operator(F.lit(None), T.NullType(), op, operand)  # unknown operators raise here too
                parts.append(F.lit(False))
            else:
                parts.append(_operator(F.col(f"`{field}`"), schema[field].dataType, op, operand))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
