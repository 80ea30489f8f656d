"""The four models by name, over tables of Spark's catalog."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import document as doc
from .operators import kv, log, queue
from .sources import catalog

SLICE_ROWS = 4_000_000  # records of a partition that one task numbers


class Collection:
    """A document collection. Reads are DataFrames; mutations write the new rows in the table's place."""

    def __init__(self, spark: SparkSession, name: str, id_col: str = "_id"):
        self.spark, self.name, self.id_col = spark, name, id_col

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def find(self, spec=None, order=None, skip=0, limit=0, projection=None) -> DataFrame:
        return doc.find(self.rows, spec, order, skip, limit, projection, self.id_col)

    def find_one(self, spec=None, projection=None) -> DataFrame:
        return doc.find_one(self.rows, spec, projection, self.id_col)

    def count(self, spec=None) -> int:
        return doc.count(self.rows, spec).first().n

    def distinct(self, field: str, spec=None) -> DataFrame:
        return doc.distinct(self.rows, field, spec)

    def aggregate(self, stages: list[dict]) -> DataFrame:
        return doc.aggregate(self.rows, stages, self.id_col)

    def _check_unique(self, rows: DataFrame) -> None:
        for name, index in catalog.list_indexes(self.spark, self.name).items():
            if index["unique"] and not doc.duplicate_keys(rows, list(index["keys"]), index["sparse"]).isEmpty():
                raise ValueError(f"unique index {name} is violated")

    def _write(self, rows: DataFrame) -> None:
        self._check_unique(rows)
        catalog.replace_rows(rows, self.name)

    def insert_one(self, document: dict[str, Any]) -> None:
        self._write(doc.insert_one(self.rows, document, self.id_col))

    def insert_many(self, new: DataFrame, ordered: bool = True) -> None:
        self._write(doc.insert_many(self.rows, new, self.id_col, ordered))

    def update_one(self, spec, update, upsert=False, new_id=None) -> None:
        self._write(doc.update_one(self.rows, spec, update, self.id_col, upsert, new_id))

    def update_many(self, spec, update) -> None:
        self._write(doc.update_many(self.rows, spec, update))

    def replace_one(self, spec, document, upsert=False, new_id=None) -> None:
        self._write(doc.replace_one(self.rows, spec, document, self.id_col, upsert, new_id))

    def delete_one(self, spec) -> None:
        self._write(doc.delete_one(self.rows, spec, self.id_col))

    def delete_many(self, spec) -> None:
        self._write(doc.delete_many(self.rows, spec))

    def bulk_write(self, operations: list[dict], ordered: bool = True) -> list[str]:
        rows, errors = doc.bulk_write(self.rows, operations, self.id_col, ordered)
        self._write(rows)
        return errors


class KeyValue:
    """Keys over an append-only table of mutations."""

    SCHEMA = "key string, value string, seq long, op string, expires_at timestamp, by long"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            catalog.create_collection(spark.createDataFrame([], self.SCHEMA), name, kind="keys")

    @property
    def log(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, rows: list[tuple]) -> None:
        """(key, value, op, expires_at, by), in order; numbers go on from the largest so far. One writer at a time."""
        start = (self.log.agg(F.max("seq")).first()[0] or 0) + 1
        rows = [(k, v, start + i, op, until, by) for i, (k, v, op, until, by) in enumerate(rows)]
        self.spark.createDataFrame(rows, self.SCHEMA).write.insertInto(self.name)

    @staticmethod
    def _until(ttl: int, now: dt.datetime) -> dt.datetime | None:
        return now + dt.timedelta(seconds=ttl) if ttl > 0 else None

    def set(self, key: str, value: str, now: dt.datetime, ttl: int = 0) -> None:
        if not key:
            raise ValueError("empty key")
        self._append([(key, value, "SET", self._until(ttl, now), None)])

    def mset(self, pairs: dict[str, str]) -> None:
        self._append([(k, v, "SET", None, None) for k, v in pairs.items()])

    def delete(self, *keys: str) -> None:
        self._append([(k, None, "DEL", None, None) for k in keys])

    def expire(self, key: str, ttl: int, now: dt.datetime) -> None:
        if ttl <= 0:
            raise ValueError("ttl must be over 0")
        self._append([(key, None, "EXPIRE", self._until(ttl, now), None)])

    def incr(self, key: str, by: int = 1) -> None:
        self._append([(key, None, "INCR", None, by)])

    def decr(self, key: str, by: int = 1) -> None:
        self.incr(key, -(by or 1))

    def view(self, now: dt.datetime) -> DataFrame:
        return kv.view(self.log, F.lit(now))

    def get(self, key: str, now: dt.datetime) -> DataFrame:
        return kv.get(self.view(now), key)

    def mget(self, keys: list[str], now: dt.datetime) -> DataFrame:
        return kv.mget(self.view(now), keys)

    def exists(self, keys: list[str], now: dt.datetime) -> DataFrame:
        return kv.exists(self.view(now), keys)

    def keys(self, now: dt.datetime, pattern: str = "*", limit: int = 1000) -> DataFrame:
        return kv.keys(self.view(now), pattern, limit)

    def ttl(self, now: dt.datetime) -> DataFrame:
        return kv.ttl(self.view(now), F.lit(now))

    def counters(self) -> DataFrame:
        return kv.counter_totals(self.log)

    def delete_pattern(self, pattern: str, now: dt.datetime) -> None:
        """Tombstones for all keys that fit, as one append by Spark."""
        start = (self.log.agg(F.max("seq")).first()[0] or 0) + 1
        gone = kv.keys(self.view(now), pattern, 0).select("key", F.lit(None).cast("string"), F.lit(start).cast("long"), F.lit("DEL"), F.lit(None).cast("timestamp"), F.lit(None).cast("long"))
        gone.write.insertInto(self.name)

    def compact(self, now: dt.datetime) -> None:
        """One SET for each key that is there; numbers go on from 1."""
        kept = kv.compact(self.log, F.lit(now)).withColumn("by", F.lit(None).cast("long")).select(*self.log.columns)
        catalog.replace_rows(kept, self.name)


class Queues:
    """Queues in one table of messages."""

    SCHEMA = "queue string, id string, data string, created_at timestamp, delay_until timestamp, retry_count int, state string, consumer_id string"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            catalog.create_collection(spark.createDataFrame([], self.SCHEMA), name, kind="queues")

    @property
    def messages(self) -> DataFrame:
        return self.spark.table(self.name)

    def push(self, new: DataFrame, now: dt.datetime, delay_seconds: int = 0) -> None:
        """Rows of queue, id, data; created_at if they have one."""
        rows = new if "consumer_id" in new.columns else new.withColumn("consumer_id", F.lit(None).cast("string"))
        empty = self.messages.limit(0)
        queue.push(empty, rows, F.lit(now), delay_seconds).write.insertInto(self.name)

    def push_batch(self, name: str, messages: list[tuple[str, str]], now: dt.datetime, delay_seconds: int = 0) -> None:
        """(id, data) of each message, in order; more than PUSH_MOST raise ValueError. Larger batches: push, with a DataFrame."""
        if len(messages) > queue.PUSH_MOST:
            raise ValueError(f"more than {queue.PUSH_MOST} messages")
        rows = [(name, i, data, now + dt.timedelta(microseconds=k)) for k, (i, data) in enumerate(messages)]
        self.push(self.spark.createDataFrame(rows, "queue string, id string, data string, created_at timestamp"), now, delay_seconds)

    def peek(self, name: str, now: dt.datetime, n: int = 10) -> DataFrame:
        return queue.peek(self.messages, name, F.lit(now), n)

    def pop(self, name: str, now: dt.datetime, n: int = 1, consumer: str | None = None) -> list:
        """The popped messages, at most 100; they are in_flight until ack or nack."""
        popped, after = queue.pop(self.messages, F.lit(now), n, consumer, name)
        rows = popped.orderBy("pos").collect()  # at most 100
        catalog.replace_rows(after, self.name)
        return rows

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def ack(self, ids: list[str]) -> None:
        catalog.replace_rows(queue.ack(self.messages, self._ids(ids)), self.name)

    def nack(self, ids: list[str], now: dt.datetime) -> None:
        """An unknown id raises ValueError, and none is given back."""
        unknown = self._ids(ids).join(self.messages, "id", "left_anti").limit(1).collect()
        if unknown:
            raise ValueError(f"no message {unknown[0].id}")
        catalog.replace_rows(queue.nack(self.messages, self._ids(ids), F.lit(now)), self.name)

    def stats(self) -> DataFrame:
        return queue.stats(self.messages)

    def names(self) -> DataFrame:
        return queue.names(self.messages)

    def purge(self, name: str) -> None:
        catalog.replace_rows(queue.purge(self.messages, name), self.name)


class Topic:
    """A partitioned log in a table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def create(cls, spark: SparkSession, name: str, partitions: int = 1) -> Topic:
        """An existing topic raises ValueError; under 1 partition is 1."""
        schema = "topic string, partition_key string, timestamp timestamp, seq long, data string, headers map<string,string>, partition int, offset long"
        catalog.create_collection(spark.createDataFrame([], schema), name, {"partitions": str(max(1, partitions))}, kind="topic")
        catalog.create_collection(spark.createDataFrame([], cls.OFFSETS), f"{name}__offsets", kind="offsets")
        return cls(spark, name)

    #: What consumers and groups did: role is consumer, group or member; a later row of one place replaces an earlier one.
    OFFSETS = "role string, owner string, member string, partition int, offset long, at timestamp, seq long"

    @staticmethod
    def names(spark: SparkSession) -> list[str]:
        return catalog.list_collections(spark, "topic")

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def partitions(self) -> int:
        return int(catalog.options(self.spark, self.name)["partitions"])

    def publish(self, records: DataFrame) -> None:
        """Rows of partition_key, timestamp, seq, data, headers. One that can't be published raises ValueError, and none is."""
        named = records.withColumn("topic", F.lit(self.name))
        if not named.where(log.reject_reason(F.col("topic"), F.col("data")).isNotNull()).isEmpty():
            raise ValueError("a record has no data or too much")
        base = self.rows.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
        slices = max(1, named.count() // (self.partitions * SLICE_ROWS))
        log.publish(named, self.partitions, base, slices=slices).select(*self.rows.columns).write.insertInto(self.name)

    def publish_batch(self, records: list[tuple[str | None, str, dict[str, str] | None]], now: dt.datetime) -> None:
        """(partition key, data, headers) of each record, in order; more than PUBLISH_MOST raise ValueError. Larger batches: publish, with a DataFrame."""
        if len(records) > log.PUBLISH_MOST:
            raise ValueError(f"more than {log.PUBLISH_MOST} records")
        start = (self.rows.agg(F.max("seq")).first()[0] or 0) + 1
        rows = [(key, now, start + i, data, headers) for i, (key, data, headers) in enumerate(records)]
        self.publish(self.spark.createDataFrame(rows, "partition_key string, timestamp timestamp, seq long, data string, headers map<string,string>"))

    def produce(self, records: DataFrame, attempts: int = 3, wait_seconds: float = 0.1) -> None:
        """publish() with an idempotency key for each record, again after a failure, each time after twice the wait. Bad records raise ValueError at once."""
        folder = f"{catalog._versions(self.spark, self.name)}-outbox/{uuid.uuid4().hex}"
        log.with_idempotency_keys(records).write.parquet(folder)  # all attempts publish the same keys
        ready = self.spark.read.parquet(folder)
        for k in range(attempts):
            try:
                self.publish(ready)
                break
            except ValueError:
                raise
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(wait_seconds * 2**k)
        where, fs = catalog._files(self.spark, folder)
        fs.delete(where, True)

    def once(self) -> DataFrame:
        """The records, those with one idempotency key once."""
        keyed = self.rows.withColumn("__key", F.element_at("headers", F.lit(log.IDEMPOTENCY_HEADER)))
        return log.deduplicate(keyed, "__key").drop("__key")

    @property
    def _offsets(self) -> DataFrame:
        return self.spark.table(f"{self.name}__offsets")

    def _note(self, role: str, owner: str, member: str | None, partition: int, offset: int | None, at: dt.datetime | None) -> None:
        if not owner:
            raise ValueError("no name of a consumer or group")
        seq = (self._offsets.agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(role, owner, member, partition, offset, at, seq)], self.OFFSETS).write.insertInto(f"{self.name}__offsets")

    def _latest(self, role: str) -> DataFrame:
        rows = self._offsets.where(F.col("role") == role)
        return rows.groupBy("owner", "member", "partition").agg(F.max_by(F.struct("offset", "at"), "seq").alias("s")).select("owner", "member", "partition", "s.offset", "s.at")

    def _offset_of(self, role: str, owner: str, partition: int) -> int:
        row = self._latest(role).where((F.col("owner") == owner) & (F.col("partition") == partition)).first()
        return row.offset if row else 0

    def seek(self, consumer: str, partition: int, offset: int) -> None:
        if offset < 0:
            raise ValueError("negative offset")
        self._note("consumer", consumer, None, partition, offset, None)

    def offset(self, consumer: str, partition: int) -> int:
        """Where a consumer stands; 0 if it never moved."""
        return self._offset_of("consumer", consumer, partition)

    def commit(self, group: str, partition: int, offset: int) -> None:
        self._note("group", group, None, partition, offset, None)

    def committed(self, group: str, partition: int) -> int:
        return self._offset_of("group", group, partition)

    def join(self, group: str, member: str, now: dt.datetime) -> None:
        """Enter a group, or say that one is still there."""
        self._note("member", group, member, 0, 1, now)

    def leave(self, group: str, member: str, now: dt.datetime) -> None:
        self._note("member", group, member, 0, 0, now)

    def members(self, group: str, now: dt.datetime, timeout_seconds: int = 10) -> DataFrame:
        """group, member of those who joined, or said so again, within the timeout and did not leave."""
        there = self._latest("member").where((F.col("owner") == group) & (F.col("offset") == 1)).select(F.col("owner").alias("group"), "member", "at")
        return log.live_members(there, F.lit(now), timeout_seconds)

    def assignment(self, group: str, now: dt.datetime, timeout_seconds: int = 10) -> DataFrame:
        """group, partition, member."""
        return log.assignment(self.members(group, now, timeout_seconds), self.partitions)

    def lag(self, group: str) -> DataFrame:
        """topic, group, partition, committed, next_offset, lag."""
        partitions = self.spark.range(self.partitions).select(F.col("id").cast("int").alias("partition"))
        held = self._latest("group").where(F.col("owner") == group).select("partition", "offset")
        committed = partitions.join(held, "partition", "left").select(F.lit(self.name).alias("topic"), F.lit(group).alias("group"), "partition", F.coalesce("offset", F.lit(0)).alias("committed"))
        return log.lag(self.rows, committed)

    def poll(self, group: str, member: str, now: dt.datetime, limit: int = log.READ_DEFAULT) -> DataFrame:
        """The next records after what the group committed, of each partition that the member is assigned; those whose time has run out are left out."""
        mine = self.assignment(group, now).where(F.col("member") == member).select("partition")
        committed = self._latest("group").where(F.col("owner") == group).select("partition", F.col("offset").alias("__from"))
        rows = log.expire(self.rows, F.lit(now)).join(F.broadcast(mine), "partition", "left_semi").join(F.broadcast(committed), "partition", "left")  # a row for each partition
        rows = rows.where(F.col("offset") >= F.coalesce("__from", F.lit(0))).drop("__from")
        place = F.row_number().over(Window.partitionBy("partition").orderBy("offset"))
        return rows.withColumn("__n", place).where(F.col("__n") <= limit).drop("__n")

    def read(self, partition: int, offset: int = 0, limit: int = log.READ_DEFAULT) -> DataFrame:
        return log.read(self.rows, self.name, partition, offset, limit)

    def read_from(self, partition: int, timestamp: dt.datetime, limit: int = log.READ_DEFAULT) -> DataFrame:
        return log.read_from(self.rows, self.name, partition, F.lit(timestamp), limit)

    def info(self) -> DataFrame:
        return log.topic_info(self.rows)

    def purge(self) -> None:
        catalog.replace_rows(self.rows.limit(0), self.name)

    def drop(self) -> None:
        catalog.drop_collection(self.spark, self.name)
        catalog.drop_collection(self.spark, f"{self.name}__offsets")
