"""Collections of documents without a schema: rows of an id and a VARIANT `doc`, with the same operators as operators.document.

Documents may differ in their fields, and a field in its type. Columns beside the two (`_version`, `_updatedAt`) are kept. For fields that all documents
share, `typed` gives columns, which Spark prunes and pushes down better.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants
from .document import _yes

ID, DOC = "_id", "doc"


def from_json(rows: DataFrame, text: str = "json", id_col: str = ID) -> DataFrame:
    """Documents from rows of an id and a JSON text; a text that isn't an object raises an error when it is read."""
    return rows.select(F.col(id_col).cast("string").alias(ID), F.parse_json(text).alias(DOC))


def from_rows(rows: DataFrame, id_col: str = ID) -> DataFrame:
    """Documents from typed rows; null columns are missing fields."""
    fields = [c for c in rows.columns if c != id_col]
    return rows.select(F.col(id_col).cast("string").alias(ID), F.parse_json(F.to_json(F.struct(*(f"`{c}`" for c in fields)))).alias(DOC))


def typed(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The id and some fields as columns of given types; null where a field is missing or can't be read as such."""
    return docs.select(ID, *(F.try_variant_get(DOC, variants.path(n), kind).alias(n) for n, kind in fields.items()))


def project(docs: DataFrame, spec: dict[str, Any] | None) -> DataFrame:
    """The named fields if any value is true or non-zero, else all but the named ones. The id stays."""
    if not spec:
        return docs
    include = any(_yes(v) for v in spec.values())
    names = [k for k, v in spec.items() if (_yes(v) if include else True) and k != ID]
    return docs.withColumn(DOC, variants.projected(DOC, names, include))


def sort(docs: DataFrame, order: list[tuple[str, int]]) -> DataFrame:
    """By fields in the order given, negative numbers downwards; ties by id."""
    keys = [k for name, d in order for k in ([F.col(ID).desc() if d < 0 else F.col(ID)] if name == ID else variants.sort_keys(DOC, name, d < 0))]
    return docs.orderBy(*keys, F.col(ID))


def find(docs: DataFrame, spec: dict[str, Any] | None = None, order: list[tuple[str, int]] | None = None, skip: int = 0, limit: int = 0, projection: dict[str, Any] | None = None) -> DataFrame:
    """filter, sort, skip, limit (0: all), project. Without an order a page is in id order."""
    out = docs.where(variants.matches(spec, DOC, ID)) if spec else docs
    if order or skip or limit:
        out = sort(out, order or [])
    out = out.offset(skip) if skip > 0 else out
    out = out.limit(limit) if limit > 0 else out
    return project(out, projection)


def count(docs: DataFrame, spec: dict[str, Any] | None = None) -> DataFrame:
    return docs.where(variants.matches(spec, DOC, ID)).agg(F.count("*").alias("n"))


def distinct(docs: DataFrame, field: str, spec: dict[str, Any] | None = None) -> DataFrame:
    """The distinct values of a field where it is present, as JSON: VARIANT itself can't be grouped."""
    value = variants.Field(DOC, field)
    return docs.where(variants.matches(spec, DOC, ID)).where(value.present).select(F.to_json(value.value).alias("value")).distinct()


def aggregate(docs: DataFrame, stages: list[dict[str, Any]]) -> DataFrame:
    """A pipeline of $match, $sort, $skip, $limit stages; others raise ValueError."""
    for stage in stages:
        if len(stage) != 1:
            raise ValueError("a stage has one key")
        (op, arg), = stage.items()
        if op == "$match":
            docs = docs.where(variants.matches(arg, DOC, ID))
        elif op == "$sort":
            docs = sort(docs, list(arg.items()) if isinstance(arg, dict) else list(arg))
        elif op == "$skip":
            docs = docs.offset(max(0, int(arg)))
        elif op == "$limit":
            docs = docs.limit(max(0, int(arg)))
        else:
            raise ValueError(f"unknown stage {op}")
    return docs


def _update_where(docs: DataFrame, hit: Column, update: dict[str, Any], now: Column | None) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    out = docs.withColumn("__hit", hit).withColumn(DOC, F.when(F.col("__hit"), variants.updated(DOC, update)).otherwise(F.col(DOC)))
    if "_version" in docs.columns:
        out = out.withColumn("_version", F.when(F.col("__hit"), F.coalesce("_version", F.lit(0)) + 1).otherwise(F.col("_version")))
    if "_updatedAt" in docs.columns and now is not None:
        out = out.withColumn("_updatedAt", F.when(F.col("__hit"), now).otherwise(F.col("_updatedAt")))
    return out.drop("__hit")


def update_many(docs: DataFrame, spec: dict[str, Any] | None, update: dict[str, Any], now: Column | None = None) -> DataFrame:
    return _update_where(docs, variants.matches(spec, DOC, ID), update, now)


def _first(docs: DataFrame, spec: dict[str, Any] | None) -> DataFrame:
    """One row: the least id that matches, or null."""
    return docs.where(variants.matches(spec, DOC, ID)).agg(F.min(ID).alias("__first"))


def update_one(docs: DataFrame, spec: dict[str, Any] | None, update: dict[str, Any], upsert: bool = False, new_id: str | None = None, now: Column | None = None) -> DataFrame:
    """The first match in id order. With upsert and no match, a document of the filter's plain values with the update done to it is added."""
    flagged = docs.join(F.broadcast(_first(docs, spec)), F.col(ID) == F.col("__first"), "left")  # one row is broadcast
    out = _update_where(flagged, F.col("__first").isNotNull(), update, now).drop("__first")
    if not upsert:
        return out
    plain = {k: v for k, v in (spec or {}).items() if not isinstance(v, dict)}
    fresh = docs.sparkSession.range(1).select(F.lit(new_id or plain.pop(ID, None)).cast("string").alias(ID), F.parse_json(F.lit(json.dumps(plain))).alias(DOC))
    fresh = fresh.withColumn(ID, F.coalesce(ID, F.uuid())).withColumn(DOC, variants.updated(DOC, update))
    none = _first(docs, spec).where(F.col("__first").isNull())
    return out.unionByName(fresh.join(F.broadcast(none), how="cross").drop("__first"), allowMissingColumns=True)


def replace_one(docs: DataFrame, spec: dict[str, Any] | None, document: dict[str, Any]) -> DataFrame:
    """The first match in id order keeps its id and takes the fields of `document`."""
    flagged = docs.join(F.broadcast(_first(docs, spec)), F.col(ID) == F.col("__first"), "left")
    return flagged.withColumn(DOC, F.when(F.col("__first").isNotNull(), variants.literal({k: v for k, v in document.items() if k != ID})).otherwise(F.col(DOC))).drop("__first")


def delete_many(docs: DataFrame, spec: dict[str, Any] | None) -> DataFrame:
    return docs.where(~variants.matches(spec, DOC, ID))


def delete_one(docs: DataFrame, spec: dict[str, Any] | None) -> DataFrame:
    flagged = docs.join(F.broadcast(_first(docs, spec)), F.col(ID) == F.col("__first"), "left")
    return flagged.where("__first IS NULL").drop("__first")


def insert_many(docs: DataFrame, new: DataFrame) -> DataFrame:
    """docs with the rows of `new` whose id isn't there yet; of several with one id the first in the order of their JSON. Rows without an id get a UUID."""
    new = new.withColumn(ID, F.coalesce(ID, F.uuid()))
    one = new.groupBy(ID).agg(F.min(F.to_json(DOC)).alias(DOC)).withColumn(DOC, F.parse_json(DOC))
    return docs.unionByName(one.join(docs.select(ID), ID, "left_anti"), allowMissingColumns=True)
