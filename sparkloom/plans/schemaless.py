"""Queries over schema-less documents, each beside DuckDB's SQL over the same JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variants import Field
from ..operators import schemaless as loose
from ..sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Documents whose field v is a number, a text, null or missing by turns, and w a text that may read as a number.
_JSON = """concat('{"user":', user_id, ',"type":"', event_type, '"', CASE event_id % 4 WHEN 0 THEN concat(',"v":', event_id % 50) WHEN 1 THEN concat(',"v":"', event_id % 50, '"') WHEN 2 THEN ',"v":null' ELSE '' END,
CASE WHEN event_id % 3 = 0 THEN concat(',"w":"', event_type, '"') WHEN event_id % 3 = 1 THEN concat(',"w":"', event_id % 90, '"') ELSE concat(',"w":', event_id % 90, '.5') END, ',"tags":[', event_id % 3, ',"', event_type, '"]}')"""
_DOCS = f"(SELECT CAST(event_id AS VARCHAR) AS _id, CAST({_JSON} AS JSON) AS j FROM events)"
_V = "json_type(j, '$.v')"
_NUMBER = "json_type(j, '$.v') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
_W = "json_extract_string(j, '$.w')"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return loose.from_json(load(spark, sf, "events").select(F.col("event_id").cast("string").alias("_id"), F.expr(_JSON).alias("json")))


def _find(spark, sf, spec) -> DataFrame:
    return loose.find(docs(spark, sf), spec).select("_id")


@query(f"SELECT _id FROM {_DOCS} WHERE {_NUMBER} AND CAST(j->>'$.v' AS DOUBLE) = 4")
def var_filter_eq_number(spark, sf):
    return _find(spark, sf, {"v": 4})


@query(f"SELECT _id FROM {_DOCS} WHERE {_V} = 'VARCHAR' AND j->>'$.v' = '5'")
def var_filter_eq_text(spark, sf):
    return _find(spark, sf, {"v": "5"})


@query(f"SELECT _id FROM {_DOCS} WHERE {_V} = 'NULL'")
def var_filter_eq_null(spark, sf):
    return _find(spark, sf, {"v": None})


@query(f"SELECT _id FROM {_DOCS} WHERE {_V} IS NOT NULL AND NOT ({_NUMBER} AND CAST(CASE WHEN {_NUMBER} THEN j->>'$.v' END AS DOUBLE) = 4)")
def var_filter_ne(spark, sf):
    return _find(spark, sf, {"v": {"$ne": 4}})


@query(f"SELECT _id FROM {_DOCS} WHERE CASE WHEN TRY_CAST({_W} AS DOUBLE) IS NOT NULL THEN CAST({_W} AS DOUBLE) > 60 ELSE {_W} > '60' END")
def var_filter_gt_mixed(spark, sf):
    return _find(spark, sf, {"w": {"$gt": 60}})


@query(f"SELECT _id FROM {_DOCS} WHERE CASE WHEN TRY_CAST({_W} AS DOUBLE) IS NOT NULL THEN CAST({_W} AS DOUBLE) >= 10 AND CAST({_W} AS DOUBLE) < 20 ELSE {_W} >= '10' AND {_W} < '20' END")
def var_filter_range(spark, sf):
    return _find(spark, sf, {"w": {"$gte": 10, "$lt": 20}})


@query(f"SELECT _id FROM {_DOCS} WHERE {_V} = 'NULL' OR ({_NUMBER} AND CAST(CASE WHEN {_NUMBER} THEN j->>'$.v' END AS DOUBLE) = 8) OR ({_V} = 'VARCHAR' AND j->>'$.v' = '9')")
def var_filter_in(spark, sf):
    return _find(spark, sf, {"v": {"$in": [8, "9", None]}})


@query(f"SELECT _id FROM {_DOCS} WHERE {_V} IS NOT NULL AND NOT ({_V} = 'NULL' OR ({_NUMBER} AND CAST(CASE WHEN {_NUMBER} THEN j->>'$.v' END AS DOUBLE) = 8))")
def var_filter_nin(spark, sf):
    return _find(spark, sf, {"v": {"$nin": [8, None]}})


@query(f"SELECT _id, {_W} AS w FROM {_DOCS} WHERE j->>'$.type' = 'click' ORDER BY TRY_CAST({_W} AS DOUBLE) DESC NULLS LAST, {_W} DESC, _id LIMIT 30 OFFSET 5")
def var_sort_skip_limit(spark, sf):
    found = loose.find(docs(spark, sf), {"type": "click", "w": {"$lt": 1000}}, [("w", -1)], 5, 30, {"w": 1})
    return found.select("_id", Field("doc", "w").text.alias("w"))


@query(f"SELECT _id, json_array_length(json_keys(j)) - 2 AS fields, j->>'$.v' AS v, CAST(NULL AS VARCHAR) AS type FROM {_DOCS}")
def var_project_exclude(spark, sf):
    found = loose.project(docs(spark, sf), {"type": 0, "w": 0})
    fields = F.size(F.map_keys(F.col("doc").cast("map<string,variant>")))
    return loose.typed(found.withColumn("fields", fields), {"v": "string", "type": "string"}).join(found.select("_id", fields.alias("fields")), "_id")


@query(f"SELECT j->'$.v' AS value FROM {_DOCS} WHERE {_V} IS NOT NULL GROUP BY ALL")
def var_distinct(spark, sf):
    return loose.distinct(docs(spark, sf), "v")


@query(f"SELECT count(*) AS n FROM {_DOCS} WHERE j->>'$.type' = 'purchase'")
def var_count(spark, sf):
    return loose.count(docs(spark, sf), {"type": "purchase"})


@query(f"SELECT _id FROM {_DOCS} WHERE CAST(j->>'$.user' AS BIGINT) < 200 ORDER BY CAST(j->>'$.user' AS BIGINT), _id LIMIT 40")
def var_pipeline(spark, sf):
    return loose.aggregate(docs(spark, sf), [{"$match": {"user": {"$lt": 200}}}, {"$sort": {"user": 1}}, {"$limit": 40}]).select("_id")


_HIT = "j->>'$.type' = 'click'"


@query(f"""SELECT _id, CASE WHEN NOT {_HIT} OR {_V} = 'VARCHAR' OR {_V} = 'NULL' THEN j->>'$.v' ELSE CAST(coalesce(CAST(CASE WHEN {_NUMBER} THEN j->>'$.v' END AS BIGINT), 0) + 2 AS VARCHAR) END AS v,
CASE WHEN {_HIT} THEN 'x' END AS fresh, CASE WHEN NOT {_HIT} THEN {_W} END AS w, CASE WHEN NOT {_HIT} THEN json_array_length(j, '$.tags') WHEN j->>'$.tags[0]' = '1' THEN 2 ELSE 3 END AS tags FROM {_DOCS}""")
def var_update_many(spark, sf):
    """All kinds of updates at once; what isn't of the right kind stays."""
    done = loose.update_many(docs(spark, sf), {"type": "click"}, {"$set": {"fresh": "x"}, "$unset": {"w": 1}, "$inc": {"v": 2}, "$addToSet": {"tags": "new"}, "$pull": {"tags": 1}})
    return loose.typed(done, {"v": "string", "fresh": "string", "w": "string", "tags": "array<string>"}).withColumn("tags", F.size("tags").cast("long"))


@query(f"SELECT _id, CASE WHEN _id = (SELECT min(_id) FROM {_DOCS} WHERE j->>'$.type' = 'view') THEN 'yes' END AS first FROM {_DOCS} UNION ALL SELECT 'new', 'made'")
def var_update_one_upsert(spark, sf):
    done = loose.update_one(docs(spark, sf), {"type": "view"}, {"$set": {"first": "yes"}})
    return loose.typed(loose.update_one(done, {"type": "nothing"}, {"$set": {"first": "made"}}, upsert=True, new_id="new"), {"first": "string"})


@query(f"SELECT _id FROM {_DOCS} WHERE NOT ({_V} IS NOT NULL AND {_NUMBER} AND CAST(CASE WHEN {_NUMBER} THEN j->>'$.v' END AS DOUBLE) < 25) OR {_V} IS NULL")
def var_delete_many(spark, sf):
    return loose.delete_many(docs(spark, sf).where("true"), {"v": {"$in": list(range(25))}}).select("_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name FROM nation UNION ALL SELECT '99', 'NOWHERE'")
def var_insert_many(spark, sf):
    have = loose.from_rows(load(spark, sf, "nation"), "n_nationkey")
    new = loose.from_json(spark.createDataFrame([("99", '{"n_name": "NOWHERE"}'), ("1", '{"n_name": "AGAIN"}')], "_id string, json string"))
    return loose.typed(loose.insert_many(have, new), {"n_name": "string"})
