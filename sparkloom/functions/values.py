"""How values compare: as numbers if both read as numbers, else as text in byte order."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: texts that read as a number. Spark's cast alone would also take " 1" and "1d".
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def number_of(col: Column, kind: T.DataType) -> Column:
    """The column as double, null where it doesn't read as a number."""
    if isinstance(kind, T.NumericType):
        return col.cast("double")
    if isinstance(kind, T.StringType):
        return F.when(col.rlike(NUMBER), col.try_cast("double"))
    return F.lit(None).cast("double")


def text_of(col: Column, kind: T.DataType) -> Column:
    """The column as text: whole numbers without a fraction, large and small ones with an exponent, lists in brackets."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = col.cast("double")
        plain = F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(d.cast("string"), r"\.0$", ""))
        parts = lambda i: F.regexp_extract(F.format_string("%s", d.cast("string")), r"^(-?[\d.]+?)(?:\.0)?E(-?\d+)$", i)
        power = F.concat(parts(1), F.lit("e"), F.when(parts(2).startswith("-"), "-").otherwise("+"), F.lpad(F.regexp_replace(parts(2), "-", ""), 2, "0"))
        wide = (F.abs(d) >= 1e21) | ((F.abs(d) < 1e-4) & (d != 0))
        return F.when(wide, power).otherwise(plain)
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.concat_ws(" ", F.transform(col, lambda x: text_of(x, kind.elementType))), F.lit("]"))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def python_number(value: Any) -> float | None:
    if is_number(value):
        return float(value)
    if isinstance(value, str) and re.match(NUMBER, value):
        return float(value)
    return None


def python_text(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if is_number(value):
        x = float(value)
        return str(int(x)) if x == int(x) and abs(x) < 1e21 else re.sub(r"e([+-])(\d)$", r"e\g<1>0\2", repr(x))
    if isinstance(value, (list, tuple)):
        return f"[{' '.join(map(python_text, value))}]"
    return str(value)


def literal(value: Any) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    return F.lit(value)


def equals(col: Column, kind: T.DataType, value: Any) -> Column:
    """Equality of the same type only: a number is no text, true is no number; null equals nothing."""
    if value is None:
        return F.lit(False)
    if isinstance(value, bool):
        fits = isinstance(kind, T.BooleanType)
    elif is_number(value):
        fits = isinstance(kind, T.NumericType)
    elif isinstance(value, str):
        fits = isinstance(kind, T.StringType)
    elif isinstance(value, (bytes, bytearray)):
        fits = isinstance(kind, T.BinaryType)
    elif isinstance(value, (list, tuple)):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        same = [equals(F.get(col, i), kind.elementType, v) for i, v in enumerate(value)]
        out = F.size(col) == len(value)
        for s in same:
            out = out & F.coalesce(s, F.lit(False))
        return out
    elif isinstance(value, dict):
        if not isinstance(kind, T.StructType):
            return F.lit(False)
        out = col.isNotNull()
        for f in kind.fields:
            part = col[f.name]
            out = out & (F.coalesce(equals(part, f.dataType, value[f.name]), F.lit(False)) if f.name in value else part.isNull())
        return out if set(value) <= set(kind.names) else F.lit(False)
    else:
        fits = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return col == F.lit(value) if fits else F.lit(False)


def compare(col: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """col op value for op in > >= < <=."""
    apply = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
    if value is None:
        return F.lit(False)
    number = python_number(value)
    if isinstance(kind, T.NumericType) and is_number(value):
        return apply(col, F.lit(value))  # reaches the scan as a pushed filter
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return apply(col, F.lit(value).cast(kind))
    as_text = apply(text_of(col, kind), F.lit(python_text(value)))
    if number is None:
        return apply(col, F.lit(value)) if isinstance(kind, T.StringType) and isinstance(value, str) else as_text
    n = number_of(col, kind)
    return F.when(n.isNotNull(), apply(n, F.lit(number))).otherwise(as_text)
