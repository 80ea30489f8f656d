"""Queries and mutations of document collections. A collection is a DataFrame with an id column; mutations return the new collection."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import matches
from ..functions.updates import apply_update
from ..functions.values import literal

Filter = dict[str, Any] | None


def _yes(flag: Any) -> bool:
    return flag is True or (isinstance(flag, (int, float)) and not isinstance(flag, bool) and flag != 0)


def project(df: DataFrame, spec: dict[str, Any] | None, id_col: str = "_id") -> DataFrame:
    """Inclusion if any value is true or non-zero (absent fields are skipped, the id comes too unless it is named), else exclusion."""
    if not spec:
        return df
    if any(_yes(v) for v in spec.values()):
        names = [k for k, v in spec.items() if _yes(v) and k in df.columns]
        if id_col not in spec and id_col in df.columns:
            names = [id_col, *names]
        return df.select(*(f"`{n}`" for n in names))
    return df.drop(*spec)


def sort(df: DataFrame, order: list[tuple[str, int]], id_col: str = "_id") -> DataFrame:
    """By fields in the order given, negative numbers downwards; ties by id. Fields that are not there don't count."""
    keys = [F.col(f"`{f}`").desc() if d < 0 else F.col(f"`{f}`").asc() for f, d in order if f in df.columns]
    if id_col in df.columns and id_col not in dict(order):
        keys.append(F.col(f"`{id_col}`").asc())
    return df.orderBy(*keys) if keys else df


def find(df: DataFrame, spec: Filter = None, order: list[tuple[str, int]] | None = None, skip: int = 0, limit: int = 0, projection: dict[str, Any] | None = None, id_col: str = "_id") -> DataFrame:
    """filter, sort, skip, limit (0: all), project. Without an order a page is in id order."""
    out = df.where(matches(spec, df.schema)) if spec else df
    if order or skip or limit:
        out = sort(out, order or [], id_col)
    out = out.offset(skip) if skip > 0 else out
    out = out.limit(limit) if limit > 0 else out
    return project(out, projection, id_col)


def find_with_total(df: DataFrame, spec: Filter = None, **page) -> tuple[DataFrame, DataFrame]:
    """The page, and a row with the number of all matches: two plans, as a window over all rows would put them into one task."""
    return find(df, spec, **page), count(df, spec, "total")


def find_one(df: DataFrame, spec: Filter = None, projection: dict[str, Any] | None = None, id_col: str = "_id") -> DataFrame:
    return find(df, spec, limit=1, projection=projection, id_col=id_col)


def count(df: DataFrame, spec: Filter = None, name: str = "n") -> DataFrame:
    return df.where(matches(spec, df.schema)).agg(F.count("*").alias(name))


def distinct(df: DataFrame, field: str, spec: Filter = None) -> DataFrame:
    """The distinct values of a field where it is present; none if there is no such field."""
    if field not in df.columns:
        return df.select(F.lit(None).cast("string").alias(field)).limit(0)
    return df.where(matches(spec, df.schema)).where(F.col(f"`{field}`").isNotNull()).select(f"`{field}`").distinct()


def aggregate(df: DataFrame, stages: list[dict[str, Any]], id_col: str = "_id") -> DataFrame:
    """A pipeline of $match, $sort, $skip, $limit stages. A $limit of 0 gives no rows. One key to a stage; others raise ValueError."""
    for stage in stages:
        if len(stage) != 1:
            raise ValueError("a stage has one key")
        (op, arg), = stage.items()
        if op == "$match":
            df = df.where(matches(arg, df.schema))
        elif op == "$sort":
            df = sort(df, list(arg.items()) if isinstance(arg, dict) else list(arg), id_col)
        elif op == "$skip":
            df = df.offset(max(0, int(arg)))
        elif op == "$limit":
            df = df.limit(max(0, int(arg)))
        else:
            raise ValueError(f"unknown stage {op}")
    return df


def _first(df: DataFrame, spec: Filter, id_col: str) -> DataFrame:
    """One row: the id of the first match in id order, found by a partial minimum."""
    return df.where(matches(spec, df.schema)).agg(F.min(f"`{id_col}`").alias("__first"))


def _flag_first(df: DataFrame, spec: Filter, id_col: str) -> tuple[DataFrame, Column]:
    flagged = df.join(F.broadcast(_first(df, spec, id_col)), F.col(f"`{id_col}`") == F.col("__first"), "left")  # one row is broadcast
    return flagged, F.col("__first").isNotNull()


def _new_document(df: DataFrame, fields: dict[str, Any], id_col: str, new_id: Any) -> DataFrame:
    given = {id_col: new_id, **fields}
    values = [literal(given[c]).cast(df.schema[c].dataType).alias(c) if given.get(c) is not None else F.lit(1 if c == "_version" else None).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    return df.sparkSession.range(1).select(*values)


def update_many(df: DataFrame, spec: Filter, update: dict[str, Any], now: Column | None = None) -> DataFrame:
    return apply_update(df, matches(spec, df.schema), update, now)


def update_one(df: DataFrame, spec: Filter, update: dict[str, Any], id_col: str = "_id", upsert: bool = False, new_id: Any = None, now: Column | None = None) -> DataFrame:
    """The first match in id order. With upsert and no match, a document of the filter's plain values with the update done to it is added."""
    flagged, hit = _flag_first(df, spec, id_col)
    out = apply_update(flagged, hit, update, now).drop("__first")
    if not upsert:
        return out
    fields = {k: v for k, v in (spec or {}).items() if not isinstance(v, dict)}
    fresh = apply_update(_new_document(df, fields, id_col, new_id), F.lit(True), {k: v for k, v in update.items() if k != "$unset"}, now)
    if "_version" in fresh.columns:
        fresh = fresh.withColumn("_version", F.lit(1).cast(df.schema["_version"].dataType))
    none = _first(df, spec, id_col).where(F.col("__first").isNull())
    return out.unionByName(fresh.join(F.broadcast(none), how="cross").drop("__first"), allowMissingColumns=True)


def replace_one(df: DataFrame, spec: Filter, document: dict[str, Any], id_col: str = "_id", upsert: bool = False, new_id: Any = None) -> DataFrame:
    """The first match keeps its id and `_createdAt`; all other fields are the document's or null; `_version` is 1 again."""
    flagged, hit = _flag_first(df, spec, id_col)
    keep = {id_col, "_createdAt"}
    new = lambda c: F.lit(1) if c == "_version" else literal(document[c]) if document.get(c) is not None else F.lit(None)
    out = flagged.select(*((F.col(f"`{c}`") if c in keep else F.when(hit, new(c).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`"))).alias(c) for c in df.columns))
    if upsert:
        none = _first(df, spec, id_col).where(F.col("__first").isNull())
        out = out.unionByName(_new_document(df, document, id_col, new_id).join(F.broadcast(none), how="cross").drop("__first"))
    return out


def delete_many(df: DataFrame, spec: Filter) -> DataFrame:
    return df.where(~matches(spec, df.schema).eqNullSafe(F.lit(True)))


def delete_one(df: DataFrame, spec: Filter, id_col: str = "_id") -> DataFrame:
    flagged, hit = _flag_first(df, spec, id_col)
    return flagged.where(~hit).drop("__first")


def insert_many(df: DataFrame, new: DataFrame, id_col: str = "_id", ordered: bool = False) -> DataFrame:
    """df with new rows. Rows whose id is there already, or came earlier in `new`, are skipped; with ordered they raise ValueError and nothing is inserted.

    Rows of `new` without an id get a UUID. Of rows with one id, the least in the order of all columns that can be ordered stays.
    """
    if id_col in new.columns:
        new = new.withColumn(id_col, F.coalesce(F.col(f"`{id_col}`"), F.uuid().cast(new.schema[id_col].dataType))) if dict(new.dtypes)[id_col] == "string" else new
    else:
        new = new.withColumn(id_col, F.uuid())
    keys = [f"`{f.name}`" for f in new.schema if f.dataType.typeName() not in ("map", "variant") and f.name != id_col]
    rank = F.row_number().over(Window.partitionBy(f"`{id_col}`").orderBy(*(keys or [f"`{id_col}`"])))
    one = new.withColumn("__rank", rank)
    if ordered:
        again = one.where("__rank > 1").select(id_col).unionByName(new.select(id_col).join(df.select(id_col), id_col, "left_semi"))
        if not again.isEmpty():
            raise ValueError("duplicate ids")
    fresh = one.where("__rank = 1").drop("__rank").join(df.select(id_col), id_col, "left_anti")
    return df.unionByName(fresh.select(*(f"`{c}`" for c in new.columns)), allowMissingColumns=True)


def insert_one(df: DataFrame, document: dict[str, Any], id_col: str = "_id") -> DataFrame:
    new = df.sparkSession.range(1).select(*(literal(v).cast(df.schema[k].dataType).alias(k) if k in df.columns else literal(v).alias(k) for k, v in document.items()))
    return insert_many(df, new, id_col, ordered=True)


def bulk_write(df: DataFrame, operations: list[dict[str, Any]], id_col: str = "_id", ordered: bool = True) -> tuple[DataFrame, list[str]]:
    """Operations one after the other, each {kind: arguments}; the new collection and the errors. Ordered: the first error ends it and is raised."""
    kinds = {"insert_one": insert_one, "update_one": update_one, "update_many": update_many, "replace_one": replace_one, "delete_one": delete_one, "delete_many": delete_many, "insert_many": insert_many}
    errors = []
    for op in operations:
        (kind, args), = op.items()
        try:
            if kind not in kinds:
                raise ValueError(f"unknown operation {kind}")
            df = kinds[kind](df, **args, **({"id_col": id_col} if kind not in ("update_many", "delete_many") else {}))
        except ValueError as e:
            if ordered:
                raise
            errors.append(str(e))
    return df, errors


def duplicate_keys(df: DataFrame, fields: list[str], sparse: bool = False) -> DataFrame:
    """Key values that break a unique index, with their number; sparse: rows without all fields don't count."""
    rows = df.where(" AND ".join(f"`{f}` IS NOT NULL" for f in fields)) if sparse else df
    return rows.groupBy(*(f"`{f}`" for f in fields)).agg(F.count("*").alias("n")).where("n > 1")


def collection_info(df: DataFrame) -> DataFrame:
    """documents and bytes (as JSON) of a collection, counted live."""
    size = F.octet_length(F.to_json(F.struct(*(f"`{c}`" for c in df.columns))))
    return df.agg(F.count("*").alias("documents"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
