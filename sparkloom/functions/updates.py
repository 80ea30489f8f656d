"""Update operators as projections, in a fixed order: $set, $unset, $inc, $push, $addToSet, $pull."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import literal

OPERATORS = ("$set", "$unset", "$inc", "$push", "$addToSet", "$pull")


def _typed(value: Any, kind: T.DataType | None) -> Column:
    return literal(value).cast(kind) if kind is not None else literal(value)


def apply_update(df: DataFrame, where: Column, update: dict[str, Any], now: Column | None = None) -> DataFrame:
    """df with the update done to rows where `where` holds.

    $set adds a column if the field is new; $unset makes it null; $inc starts a missing number at 0 and leaves other types alone; $push and $addToSet
    start a missing list and leave other types alone; $pull takes all equal elements out. A column `_version` goes up by one, `_updatedAt` becomes `now`.
    """
    if unknown := set(update) - set(OPERATORS):
        raise ValueError(f"unknown update operators {sorted(unknown)}")
    flag = "__hit"
    out = df.withColumn(flag, F.coalesce(where, F.lit(False)))

    def put(df: DataFrame, name: str, new: Column) -> DataFrame:
        old = F.col(f"`{name}`") if name in df.columns else F.lit(None)
        return df.withColumn(name, F.when(F.col(flag), new).otherwise(old))

    for op in OPERATORS:
        for name, value in (update.get(op) or {}).items():
            kind = out.schema[name].dataType if name in out.columns else None
            old = F.col(f"`{name}`")
            if op == "$set":
                same = kind is not None and (value is None or not isinstance(value, (str, list, dict)) or isinstance(kind, (T.StringType, T.ArrayType, T.StructType)))
                if kind is not None and not same:
                    raise ValueError(f"$set of {name}: a column of {kind.simpleString()} can't hold {value!r}")
                out = put(out, name, _typed(value, kind))
            elif op == "$unset":
                out = put(out, name, F.lit(None)) if kind is not None else out
            elif op == "$inc":
                if kind is None:
                    out = put(out, name, literal(value))
                elif isinstance(kind, T.NumericType):
                    out = put(out, name, (F.coalesce(old, F.lit(0)) + F.lit(value)))
            elif kind is None and op != "$pull":
                out = put(out, name, F.array(literal(value)))
            elif isinstance(kind, T.ArrayType):
                item, held = _typed(value, kind.elementType), F.coalesce(old, F.array().cast(kind))
                if op == "$push":
                    out = put(out, name, F.array_append(held, item))
                elif op == "$addToSet":
                    out = put(out, name, F.when(F.array_contains(held, item), held).otherwise(F.array_append(held, item)))
                else:
                    out = put(out, name, F.array_remove(old, item))
    if "_version" in out.columns:
        out = put(out, "_version", F.coalesce("_version", F.lit(0)) + 1)
    if "_updatedAt" in out.columns and now is not None:
        out = put(out, "_updatedAt", now)
    return out.drop(flag)
