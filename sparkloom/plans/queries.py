"""A query for every operator of the four data models, each beside the SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import glob
from ..operators import document as doc
from ..operators import kv, log, queue
from ..session import shared_folder
from ..sources.tables import backup, kv_log, load, log_records, queue_messages, restore
from ..streaming import consume

NOW = "2024-01-31 00:00:00"
PARTITIONS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def filtered(name: str, table: str, key: str, spec: dict, where: str) -> None:
    """A query that finds by one filter; the SQL says the same."""
    fields = [key, *spec]
    QUERIES[name] = lambda spark, sf: doc.find(load(spark, sf, table), spec, projection=dict.fromkeys(fields, 1), id_col=key)
    SQL[name] = f"SELECT {', '.join(fields)} FROM {table} WHERE {where}"


filtered("doc_filter_eq", "orders", "o_orderkey", {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
filtered("doc_filter_ne", "orders", "o_orderkey", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'")
filtered("doc_filter_gt", "orders", "o_orderkey", {"o_totalprice": {"$gt": 200000}}, "o_totalprice > 200000")
filtered("doc_filter_gte", "part", "p_partkey", {"p_size": {"$gte": 25}}, "p_size >= 25")
filtered("doc_filter_lt", "lineitem", "l_orderkey", {"l_quantity": {"$lt": 5}}, "l_quantity < 5")
filtered("doc_filter_lte", "customer", "c_custkey", {"c_acctbal": {"$lte": 0}}, "c_acctbal <= 0")
filtered("doc_filter_in", "customer", "c_custkey", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')")
filtered("doc_filter_nin", "customer", "c_custkey", {"c_mktsegment": {"$nin": ["BUILDING", None, "MACHINERY"]}}, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
filtered("doc_filter_multi_op", "orders", "o_orderkey", {"o_totalprice": {"$gte": 50000, "$lt": 100000}, "o_orderstatus": "O"}, "o_totalprice >= 50000 AND o_totalprice < 100000 AND o_orderstatus = 'O'")
filtered("doc_filter_type_mismatch", "orders", "o_orderkey", {"o_orderkey": "1"}, "false")
SQL["doc_filter_type_mismatch"] = "SELECT o_orderkey FROM orders WHERE false"
QUERIES["doc_filter_type_mismatch"] = lambda spark, sf: doc.find(load(spark, sf, "orders"), {"o_orderkey": "1"}, projection={"o_orderkey": 1}, id_col="o_orderkey")

_NUMBER = "'^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$'"


@query(f"""SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN regexp_extract(props, '[0-9]+') WHEN event_id % 3 = 1 THEN ' ' || regexp_extract(props, '[0-9]+') ELSE event_type END AS v FROM events)
WHERE CASE WHEN regexp_matches(v, {_NUMBER}) THEN CAST(v AS DOUBLE) > 40 ELSE v > '40' END""")
def doc_filter_mixed_type(spark, sf):
    digits = F.regexp_extract("props", "[0-9]+", 0)
    text = F.when(F.col("event_id") % 3 == 0, digits).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), digits)).otherwise(F.col("event_type"))
    return doc.find(load(spark, sf, "events").select("event_id", text.alias("v")), {"v": {"$gt": 40}}, id_col="event_id")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def doc_project_include(spark, sf):
    return doc.project(load(spark, sf, "customer"), {"c_name": 1, "c_nationkey": True, "nothing": 1}, "c_custkey")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def doc_project_exclude(spark, sf):
    return doc.project(load(spark, sf, "customer"), {"c_acctbal": 0, "c_nationkey": False}, "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def doc_sort_skip_limit(spark, sf):
    return doc.find(load(spark, sf, "orders"), {"o_orderstatus": "F"}, [("o_totalprice", -1)], 5, 20, {"o_totalprice": 1}, "o_orderkey")


@query("SELECT o_orderkey, o_orderpriority, o_custkey FROM orders ORDER BY o_orderpriority, o_custkey DESC, o_orderkey LIMIT 50")
def doc_sort_multi_key(spark, sf):
    return doc.find(load(spark, sf, "orders"), None, [("o_orderpriority", 1), ("o_custkey", -1)], 0, 50, {"o_orderpriority": 1, "o_custkey": 1}, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice, total FROM (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_totalprice > 100000) ORDER BY o_orderkey LIMIT 10")
def doc_find_total(spark, sf):
    page, total = doc.find_with_total(load(spark, sf, "orders"), {"o_totalprice": {"$gt": 100000}}, limit=10, projection={"o_totalprice": 1}, id_col="o_orderkey")
    return page.join(F.broadcast(total), how="cross")  # one row


@query("SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 1")
def doc_find_one(spark, sf):
    return doc.find_one(load(spark, sf, "orders"), {"o_orderpriority": "1-URGENT"}, id_col="o_orderkey")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05")
def doc_count(spark, sf):
    return doc.count(load(spark, sf, "lineitem"), {"l_returnflag": "R", "l_discount": {"$gte": 0.05}})


@query("SELECT DISTINCT p_brand FROM part WHERE p_size > 10 AND p_brand IS NOT NULL")
def doc_distinct(spark, sf):
    return doc.distinct(load(spark, sf, "part"), "p_brand", {"p_size": {"$gt": 10}})


@query("SELECT * FROM orders WHERE o_totalprice < 150000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 10")
def doc_pipeline(spark, sf):
    return doc.aggregate(load(spark, sf, "orders"), [{"$match": {"o_totalprice": {"$lt": 150000}}}, {"$sort": {"o_orderdate": -1}}, {"$skip": 10}, {"$limit": 25}], "o_orderkey")


@query("SELECT * FROM orders WHERE false")
def doc_pipeline_limit_zero(spark, sf):
    return doc.aggregate(load(spark, sf, "orders"), [{"$limit": 0}], "o_orderkey")


@query("SELECT count(*) AS documents FROM nation")
def doc_collection_info(spark, sf):
    return doc.collection_info(load(spark, sf, "nation")).select("documents")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def doc_unique_violations(spark, sf):
    return doc.duplicate_keys(load(spark, sf, "orders"), ["o_custkey"])


_F = {"c_mktsegment": "BUILDING"}


@query("SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN 'gold' ELSE c_name END AS c_name) FROM customer")
def upd_set(spark, sf):
    return doc.update_many(load(spark, sf, "customer"), _F, {"$set": {"c_name": "gold"}})


@query("SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END AS c_nationkey) FROM customer")
def upd_unset(spark, sf):
    return doc.update_many(load(spark, sf, "customer"), _F, {"$unset": {"c_nationkey": 1}})


@query("SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 2.5 ELSE c_acctbal END AS c_acctbal) FROM customer")
def upd_inc(spark, sf):
    return doc.update_many(load(spark, sf, "customer"), _F, {"$inc": {"c_acctbal": 2.5, "c_name": 1}})


def _lists(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", "label", F.array(F.col("label"), F.col("label") + 1).alias("tags"))


_LISTS = "SELECT vec_id, label, [label, label + 1] AS tags FROM embeddings"


@query(f"SELECT vec_id, label, array_to_string(CASE WHEN label > 4 THEN list_append(tags, 9) ELSE tags END, ',') AS tags FROM ({_LISTS})")
def upd_push(spark, sf):
    return doc.update_many(_lists(spark, sf), {"label": {"$gt": 4}}, {"$push": {"tags": 9}}).withColumn("tags", F.concat_ws(",", F.transform("tags", lambda x: x.cast("string"))))


@query(f"SELECT vec_id, label, array_to_string(list_filter(tags, lambda x: x <> 5), ',') AS tags FROM ({_LISTS})")
def upd_pull(spark, sf):
    return doc.update_many(_lists(spark, sf), None, {"$pull": {"tags": 5}}).withColumn("tags", F.concat_ws(",", F.transform("tags", lambda x: x.cast("string"))))


@query(f"SELECT vec_id, label, array_to_string(CASE WHEN list_contains(tags, 5) THEN tags ELSE list_append(tags, 5) END, ',') AS tags FROM ({_LISTS})")
def upd_add_to_set(spark, sf):
    return doc.update_many(_lists(spark, sf), None, {"$addToSet": {"tags": 5}}).withColumn("tags", F.concat_ws(",", F.transform("tags", lambda x: x.cast("string"))))


@query("SELECT * REPLACE (CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P') THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
def upd_one(spark, sf):
    return doc.update_one(load(spark, sf, "orders"), {"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "X"}}, "o_orderkey")


@query("SELECT *, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS _version FROM orders")
def upd_version(spark, sf):
    return doc.update_many(load(spark, sf, "orders").withColumn("_version", F.lit(1)), {"o_orderstatus": "P"}, {"$inc": {"o_totalprice": 0}})


@query("SELECT * FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def upd_upsert(spark, sf):
    return doc.update_one(load(spark, sf, "region"), {"r_name": "ATLANTIS"}, {"$set": {"r_name": "ATLANTIS"}}, "r_regionkey", upsert=True, new_id=99)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2) THEN 'NEW' ELSE n_name END AS n_name, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2) THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def replace_one(spark, sf):
    return doc.replace_one(load(spark, sf, "nation"), {"n_regionkey": 2}, {"n_name": "NEW"}, "n_nationkey")


@query("SELECT * FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
def del_one(spark, sf):
    return doc.delete_one(load(spark, sf, "orders"), {"o_orderstatus": "P"}, "o_orderkey")


@query("SELECT * FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_quantity > 10)")
def del_many(spark, sf):
    return doc.delete_many(load(spark, sf, "lineitem"), {"l_returnflag": "A", "l_quantity": {"$gt": 10}})


@query("SELECT * FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT * FROM supplier WHERE s_suppkey % 2 = 1")
def insert_many_unordered(spark, sf):
    all_rows = load(spark, sf, "supplier")
    return doc.insert_many(all_rows.where("s_suppkey % 2 = 0"), all_rows.unionByName(all_rows), "s_suppkey")


@query("SELECT * FROM supplier")
def insert_many_ordered(spark, sf):
    all_rows = load(spark, sf, "supplier")
    return doc.insert_many(all_rows.where("s_suppkey % 2 = 0"), all_rows.where("s_suppkey % 2 = 1"), "s_suppkey", ordered=True)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def backup_restore(spark, sf):
    """A copy of a collection in the folder that all executors share, read back."""
    path = f"{shared_folder(spark)}/backup-{uuid.uuid4().hex}"
    backup(load(spark, sf, "nation"), path)
    return restore(spark, path)


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'ONE' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 50, 'FIFTY'")
def bulk_write(spark, sf):
    done, _ = doc.bulk_write(load(spark, sf, "region"), [
        {"insert_one": {"document": {"r_regionkey": 50, "r_name": "FIFTY"}}}, {"update_one": {"spec": {"r_regionkey": 1}, "update": {"$set": {"r_name": "ONE"}}}}, {"delete_one": {"spec": {"r_regionkey": 3}}},
    ], "r_regionkey")
    return done


_KV = f"""(SELECT key, arg_max(value, seq) AS value, arg_max(expires_at, seq) AS expires_at FROM
(SELECT event_type || ':' || user_id AS key, props AS value, event_id AS seq, ts + INTERVAL 7 DAYS AS expires_at FROM events) GROUP BY key HAVING arg_max(expires_at, seq) > TIMESTAMP '{NOW}')"""


def _view(spark, sf):
    return kv.view(kv_log(load(spark, sf, "events")), now())


@query("SELECT event_type || ':' || user_id AS key, arg_max(props, event_id) AS value FROM events GROUP BY 1")
def kv_last_write_wins(spark, sf):
    return kv.latest(kv_log(load(spark, sf, "events"))).select("key", "value")


@query(f"SELECT key, value, expires_at FROM {_KV}")
def kv_ttl_visible(spark, sf):
    return _view(spark, sf)


@query(f"SELECT key, CAST(floor(epoch(expires_at - TIMESTAMP '{NOW}')) AS BIGINT) AS ttl FROM {_KV}")
def kv_ttl_remaining(spark, sf):
    return kv.ttl(_view(spark, sf), now())


@query(f"SELECT key, value FROM {_KV} WHERE key = 'click:7'")
def kv_get(spark, sf):
    return kv.get(_view(spark, sf), "click:7").select("key", "value")


@query(f"SELECT k.key, v.key IS NOT NULL AS found FROM (VALUES ('click:7'), ('nothing:0'), ('view:3')) k(key) LEFT JOIN {_KV} v ON v.key = k.key")
def kv_exists(spark, sf):
    return kv.exists(_view(spark, sf), ["click:7", "nothing:0", "view:3"])


@query(f"SELECT CAST(pos AS INTEGER) AS pos, k.key, value FROM (VALUES (0, 'view:3'), (1, 'click:7'), (2, 'nothing:0'), (3, 'view:3'), (4, 'purchase:11')) k(pos, key) JOIN {_KV} v ON v.key = k.key")
def kv_mget_ordered(spark, sf):
    return kv.mget(_view(spark, sf), ["view:3", "click:7", "nothing:0", "view:3", "purchase:11"])


@query(f"SELECT key FROM {_KV} WHERE starts_with(key, 'c') AND ends_with(key, '7')")
def kv_keys_glob(spark, sf):
    return kv.keys(_view(spark, sf), "c*7", limit=0)


@query(f"SELECT key FROM {_KV} WHERE starts_with(key, 'p')")
def kv_keys_glob_many_stars(spark, sf):
    return kv.keys(_view(spark, sf), "p*1*2", limit=0)


@query(f"SELECT key FROM {_KV} ORDER BY key LIMIT 100")
def kv_keys_limit(spark, sf):
    return kv.keys(_view(spark, sf), "*", limit=100)


@query(f"SELECT key, value FROM {_KV} WHERE key NOT IN ('click:7', 'view:3')")
def kv_delete(spark, sf):
    return kv.delete_keys(_view(spark, sf), ["click:7", "view:3", "nothing:0"]).select("key", "value")


@query(f"SELECT key, value FROM {_KV} WHERE NOT starts_with(key, 'click:')")
def kv_delete_pattern(spark, sf):
    return kv.delete_pattern(_view(spark, sf), "click:*").select("key", "value")


def _counters(spark, sf):
    return load(spark, sf, "events").select(F.concat(F.lit("c:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.lit("INCR").alias("op"), F.lit(None).cast("string").alias("value"), (F.col("event_id") % 5).alias("by"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))


@query("SELECT 'c:' || user_id AS key, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE event_id % 5 END) AS BIGINT) AS value FROM events GROUP BY user_id")
def kv_incr_total(spark, sf):
    return kv.counter_totals(_counters(spark, sf))


@query("SELECT 'c:' || user_id AS key, event_id AS seq, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE event_id % 5 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS value FROM events")
def kv_incr_running(spark, sf):
    return kv.counter_running(_counters(spark, sf)).select("key", "seq", "value")


@query(f"SELECT key, value, CAST(0 AS BIGINT) AS seq, 'SET' AS op, expires_at FROM {_KV}")
def kv_compact(spark, sf):
    return kv.compact(kv_log(load(spark, sf, "events")), now())


# A log that mixes all mutations: by event_id, a SET of a number or a text, DEL, EXPIRE of 20 days, else INCR.
_MIXED = """(SELECT 'm:' || user_id % 400 AS key, event_id AS seq, ts, CASE event_id % 13 WHEN 0 THEN 'SET' WHEN 1 THEN 'SET' WHEN 2 THEN 'DEL' WHEN 3 THEN 'EXPIRE' ELSE 'INCR' END AS op,
CASE event_id % 13 WHEN 0 THEN CAST(event_id % 100 AS VARCHAR) WHEN 1 THEN event_type END AS value, CASE WHEN event_id % 13 = 3 THEN ts + INTERVAL 20 DAYS END AS expires_at, CASE WHEN event_id % 5 = 0 THEN 1 ELSE event_id % 5 END AS delta FROM events)"""
_MIXED_VIEW = f"""(WITH m AS {_MIXED}, s AS (SELECT key, max(seq) AS top FROM m WHERE op IN ('SET', 'DEL') GROUP BY key),
l AS (SELECT m.*, coalesce(s.top, -1) AS top FROM m LEFT JOIN s ON s.key = m.key WHERE s.top IS NULL OR m.seq >= s.top),
g AS (SELECT key, any_value(op) FILTER (WHERE seq = top) AS op, any_value(value) FILTER (WHERE seq = top AND op = 'SET') AS value, sum(delta) FILTER (WHERE op = 'INCR') AS d, min(seq) FILTER (WHERE op = 'INCR' OR (op = 'SET' AND seq = top)) AS born,
max(seq) FILTER (WHERE op = 'EXPIRE') AS e, max_by(expires_at, seq) FILTER (WHERE op = 'EXPIRE') AS until FROM l GROUP BY key)
SELECT key, CASE WHEN d IS NULL THEN value ELSE CAST(coalesce(TRY_CAST(value AS BIGINT), 0) + d AS VARCHAR) END AS value, CASE WHEN e > born THEN until END AS expires_at FROM g
WHERE born IS NOT NULL AND (NOT coalesce(e > born, false) OR until > TIMESTAMP '{NOW}'))"""


def _mixed(spark, sf):
    kind = F.col("event_id") % 13
    return load(spark, sf, "events").select(
        F.concat(F.lit("m:"), (F.col("user_id") % 400).cast("string")).alias("key"), F.col("event_id").alias("seq"), "ts",
        F.when(kind < 2, "SET").when(kind == 2, "DEL").when(kind == 3, "EXPIRE").otherwise("INCR").alias("op"),
        F.when(kind == 0, (F.col("event_id") % 100).cast("string")).when(kind == 1, F.col("event_type")).alias("value"),
        F.when(kind == 3, F.col("ts") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"), (F.col("event_id") % 5).alias("by"),
    )


@query(f"SELECT key, value, expires_at FROM {_MIXED_VIEW}")
def kv_mixed_view(spark, sf):
    return kv.view(_mixed(spark, sf), now())


@query(f"SELECT key, value FROM {_MIXED_VIEW} WHERE key IN ('m:7', 'm:11', 'm:13', 'm:nothing')")
def kv_get_counter(spark, sf):
    return kv.view(_mixed(spark, sf), now()).where(F.col("key").isin("m:7", "m:11", "m:13", "m:nothing")).select("key", "value")


@query(f"SELECT key, CAST(value AS BIGINT) AS value FROM {_MIXED_VIEW} WHERE regexp_full_match(value, '[0-9]+')")
def kv_mixed_counters(spark, sf):
    return kv.counter_totals(_mixed(spark, sf), now())


@query(f"""WITH m AS {_MIXED}, g AS (SELECT *, count(*) FILTER (WHERE op IN ('SET', 'DEL')) OVER (PARTITION BY key ORDER BY seq) AS part FROM m)
SELECT key, seq, CAST(value AS BIGINT) AS value FROM (SELECT key, seq, op, sum(CASE op WHEN 'INCR' THEN delta WHEN 'SET' THEN coalesce(TRY_CAST(value AS BIGINT), 0) ELSE 0 END) OVER (PARTITION BY key, part ORDER BY seq) AS value FROM g) WHERE op = 'INCR'""")
def kv_mixed_running(spark, sf):
    return kv.counter_running(_mixed(spark, sf), 1000).select("key", "seq", "value")


@query(f"SELECT key, value, expires_at FROM {_MIXED_VIEW}")
def kv_compact_mixed(spark, sf):
    """What the compacted log reads as."""
    return kv.view(kv.compact(_mixed(spark, sf), now()), now())


@query("""WITH e AS (SELECT event_type || ':' || user_id AS key, max(event_id) AS seq FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT e.key, props AS value, CASE WHEN e.seq % 3 = 0 THEN ts + INTERVAL 1 DAY END AS expires_at FROM e JOIN events ON event_id = e.seq WHERE e.seq % 3 <> 0 OR ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-10 00:00:00'""")
def kv_expire(spark, sf):
    """SETs without an expiry; those of every third number get one of a day right afterwards."""
    sets = kv_log(load(spark, sf, "events").where("event_id % 2 = 0")).withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    soon = load(spark, sf, "events").where("event_id % 6 = 0")
    times = kv_log(soon).withColumn("value", F.lit(None).cast("string")).withColumn("op", F.lit("EXPIRE")).withColumn("expires_at", F.col("expires_at") - F.expr("INTERVAL 6 DAYS")).withColumn("seq", F.col("seq") + 1)
    return kv.view(sets.unionByName(times), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query(f"SELECT key, value FROM {_KV} WHERE key NOT IN ('click:7', 'view:3') UNION ALL SELECT 'new:1', 'x' UNION ALL SELECT 'new:2', 'y'")
def kv_mset(spark, sf):
    """Rows of SET and DEL appended to a log."""
    log_ = kv_log(load(spark, sf, "events"))
    more = spark.createDataFrame([("new:1", "x", "SET"), ("new:2", "y", "SET"), ("click:7", None, "DEL"), ("view:3", None, "DEL")], "key string, value string, op string")
    more = more.select("key", "value", F.lit(10**12).alias("seq"), "op", F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    return kv.view(log_.unionByName(more), now()).select("key", "value")


def _messages(spark, sf):
    return queue_messages(load(spark, sf, "events"))


@query("SELECT event_type AS queue, event_id AS id, props AS data FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 10")
def q_peek(spark, sf):
    return queue.peek(_messages(spark, sf), "click", now()).select("queue", "id", "data")


@query("SELECT event_type AS queue, event_id AS id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS pos FROM events QUALIFY pos <= 5")
def q_pop_batch(spark, sf):
    return queue.pop(_messages(spark, sf), now(), 5)[0].select("queue", "id", "pos")


@query("SELECT event_type AS queue, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1")
def q_pop(spark, sf):
    return queue.pop(_messages(spark, sf), now())[0].select("queue", "id")


@query("SELECT event_type AS queue, event_id AS id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 3 THEN 'in_flight' ELSE 'ready' END AS state FROM events")
def q_after_pop(spark, sf):
    return queue.pop(_messages(spark, sf), now(), 3)[1].select("queue", "id", "state")


@query("SELECT event_type AS queue, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) > 4")
def q_after_ack(spark, sf):
    popped, after = queue.pop(_messages(spark, sf), now(), 4)
    return queue.ack(after, popped).select("queue", "id")


@query(f"SELECT event_type AS queue, event_id AS id, CASE WHEN rn <= 2 THEN TIMESTAMP '{NOW}' + INTERVAL 1 SECOND END AS delay_until, CASE WHEN rn <= 2 THEN 1 ELSE 0 END AS retry_count FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)")
def q_nack_backoff(spark, sf):
    popped, after = queue.pop(_messages(spark, sf), now(), 2)
    return queue.nack(after, popped, now()).select("queue", "id", "delay_until", "retry_count")


@query("SELECT event_type AS queue, count(*) - 3 AS size, CAST(3 AS BIGINT) AS pending, CAST(3 AS BIGINT) AS processed, CAST(0 AS BIGINT) AS retried FROM events GROUP BY event_type")
def q_stats(spark, sf):
    return queue.stats(queue.pop(_messages(spark, sf), now(), 3)[1])


@query("SELECT DISTINCT event_type AS queue FROM events")
def q_list(spark, sf):
    return queue.names(_messages(spark, sf))


@query("SELECT event_type AS queue, event_id AS id FROM events WHERE event_type <> 'view'")
def q_purge(spark, sf):
    return queue.purge(_messages(spark, sf), "view").select("queue", "id")


@query("SELECT event_type AS queue, event_id AS id, CASE WHEN event_id % 2 = 1 THEN ts + INTERVAL 30 SECOND END AS delay_until FROM events")
def q_push_delayed(spark, sf):
    m = _messages(spark, sf)
    return queue.push(m.where("id % 2 = 0"), m.where("id % 2 = 1").select("queue", "id", "data", "created_at"), now(), 30).select("queue", "id", "delay_until")


_FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(partition_key, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296)"
_LOG = f"""(SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY "timestamp", seq) - 1 AS "offset" FROM
(SELECT *, CAST({_FNV} % {PARTITIONS} AS INTEGER) AS "partition" FROM (SELECT 'events' AS topic, 'user_' || user_id AS partition_key, ts AS "timestamp", event_id AS seq, props AS data, user_id || ':' || event_type AS idempotency_key FROM events)))"""


def _log(spark, sf):
    return log.publish(log_records(load(spark, sf, "events")), PARTITIONS)


@query(f'SELECT seq, partition_key, "partition" FROM {_LOG}')
def st_partition(spark, sf):
    return _log(spark, sf).select("seq", "partition_key", "partition")


@query(f'SELECT seq, "partition", "offset" FROM {_LOG}')
def st_offsets(spark, sf):
    return _log(spark, sf).select("seq", "partition", "offset")


@query(f'SELECT seq, "partition", "offset" FROM {_LOG}')
def st_offsets_sliced(spark, sf):
    """Each partition numbered in 16 times of the log."""
    return log.publish(log_records(load(spark, sf, "events")), PARTITIONS, slices=16).select("seq", "partition", "offset")


@query(f'SELECT seq, "partition", "offset" + 100 AS "offset" FROM {_LOG}')
def st_publish_after(spark, sf):
    base = spark.range(PARTITIONS).select(F.lit("events").alias("topic"), F.col("id").cast("int").alias("partition"), F.lit(100).cast("long").alias("next_offset"))
    return log.publish(log_records(load(spark, sf, "events")), PARTITIONS, base).select("seq", "partition", "offset")


@query(f'SELECT seq, "offset", data FROM {_LOG} WHERE "partition" = 2 AND "offset" >= 7 ORDER BY "offset" LIMIT 25')
def st_read(spark, sf):
    return log.read(_log(spark, sf), "events", 2, 7, 25).select("seq", "offset", "data")


@query(f"""SELECT seq, "offset", data FROM {_LOG} WHERE "partition" = 1 AND "timestamp" >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY "offset" LIMIT 25""")
def st_read_from(spark, sf):
    return log.read_from(_log(spark, sf), "events", 1, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 25).select("seq", "offset", "data")


@query(f'SELECT seq, "partition", "offset" FROM {_LOG} WHERE "partition" IN (0, 3) AND "offset" >= 5 AND "offset" < 15')
def st_read_batch(spark, sf):
    return log.read_batch(_log(spark, sf), "events", [0, 3], 5, 10).select("seq", "partition", "offset")


@query(f'SELECT seq, "offset" FROM {_LOG} WHERE "partition" = 0 ORDER BY "offset" DESC LIMIT 10')
def st_read_latest(spark, sf):
    return log.read_latest(_log(spark, sf), "events", 0).select("seq", "offset")


@query(f'SELECT topic, "partition", count(*) AS messages, max("offset") + 1 AS next_offset FROM {_LOG} GROUP BY ALL')
def st_topic_info(spark, sf):
    return log.topic_info(_log(spark, sf))


@query(f'SELECT topic, "partition", max("offset") AS latest_offset FROM {_LOG} GROUP BY ALL')
def st_latest_offset(spark, sf):
    return log.latest_offsets(_log(spark, sf))


@query("SELECT CAST(1000000 AS BIGINT) AS next_offset")
def st_next_offset_empty(spark, sf):
    return log.next_offset(log.read(_log(spark, sf), "events", 0, 1000000), 1000000).select(F.col("next_offset").cast("long").alias("next_offset"))


@query(f'SELECT topic, \'g\' AS "group", "partition", CAST(10 AS BIGINT) AS committed, max("offset") + 1 AS next_offset, max("offset") + 1 - 10 AS lag FROM {_LOG} GROUP BY topic, "partition"')
def st_group_lag(spark, sf):
    committed = spark.range(PARTITIONS).select(F.lit("events").alias("topic"), F.lit("g").alias("group"), F.col("id").cast("int").alias("partition"), F.lit(10).cast("long").alias("committed"))
    return log.lag(_log(spark, sf), committed)


@query("""SELECT 'g' AS "group", CAST(p AS INTEGER) AS "partition", ['a', 'b', 'c'][p % 3 + 1] AS member FROM range(4) t(p)""")
def st_assignment(spark, sf):
    return log.assignment(spark.createDataFrame([("g", "c"), ("g", "a"), ("g", "b"), ("g", "a")], "group string, member string"), PARTITIONS)


@query(f"""SELECT 'g' || user_id % 5 AS "group", 'm' || user_id AS member FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 2 DAYS > (SELECT max(ts) FROM events)""")
def st_live_members(spark, sf):
    """Every event is a heartbeat of its user; the last event is the time now."""
    events = load(spark, sf, "events")
    beats = events.select(F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("group"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("member"), F.col("ts").alias("at"))
    last = events.agg(F.max("ts")).first()[0]
    return log.live_members(beats, F.lit(last).cast("timestamp_ntz"), 2 * 86400)


@query("SELECT 't' AS topic, 'c1' AS consumer, CAST(p AS INTEGER) AS \"partition\", CAST(CASE WHEN p = 1 THEN 42 ELSE 0 END AS BIGINT) AS \"offset\" FROM range(3) t(p)")
def st_seek(spark, sf):
    row = lambda c: spark.range(3).select(F.lit("t").alias("topic"), F.lit("c1").alias("consumer"), F.col("id").cast("int").alias("partition"), c.cast("long").alias("offset"))
    return log.commit(row(F.lit(0)), row(F.lit(42)).where("partition = 1"))


@query(f"SELECT idempotency_key, min(seq) AS seq FROM {_LOG} GROUP BY idempotency_key")
def st_dedup(spark, sf):
    return log.deduplicate(_log(spark, sf)).select("idempotency_key", "seq")


@query("SELECT 't' AS topic, CAST(p AS INTEGER) AS \"partition\", ['n1', 'n2', 'n3'][p % 3 + 1] AS leader, ['n1', 'n2', 'n3'][p % 3 + 1] || ',' || ['n1', 'n2', 'n3'][(p + 1) % 3 + 1] AS replicas FROM range(4) t(p)")
def st_replica_placement(spark, sf):
    return log.replicas("t", 4, ["n1", "n2", "n3"], 2, spark).withColumn("replicas", F.concat_ws(",", "replicas"))


@query("SELECT event_id AS seq FROM events WHERE CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 10 DAYS > TIMESTAMP '2024-01-31 00:00:00' ELSE true END")
def st_message_ttl(spark, sf):
    rows = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"), F.create_map(F.lit("ttl"), F.when(F.col("event_id") % 3 == 0, "240h").otherwise("bad")).alias("headers"))
    return log.expire(rows, now()).select("seq")


@query("SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'empty data' END AS reason FROM events")
def st_publish_validation(spark, sf):
    return load(spark, sf, "events").select(F.col("event_id").alias("seq"), log.reject_reason(F.lit("t"), F.when(F.col("event_id") % 2 == 1, F.col("props")).otherwise("")).alias("reason"))


@query("SELECT event_id AS seq, ts FROM events WHERE event_type = 'purchase'")
def st_stream_consume(spark, sf):
    """Structured Streaming over the events table: each micro-batch goes to a folder that all executors share."""
    batch = load(spark, sf, "events")
    out = f"{shared_folder(spark)}/consume-{uuid.uuid4().hex}"
    # a folder of files is what a file stream watches
    batch.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{out}/in").where("event_type = 'purchase'").select(F.col("event_id").alias("seq"), "ts")
    done = consume.consume(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/out/batch={n}"), f"{out}/checkpoint", once=True)
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/out").select("seq", "ts")


@query("SELECT count(*) AS n FROM events WHERE starts_with(event_type, 'p')")
def glob_count(spark, sf):
    return load(spark, sf, "events").where(glob(F.col("event_type"), "p*")).agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return doc.find(load(spark, sf, "orders"), {"o_totalprice": {"$gt": 100000}, "o_orderstatus": "F"}, [("o_totalprice", -1)], 0, 100, {"o_totalprice": 1, "o_custkey": 1}, "o_orderkey")
