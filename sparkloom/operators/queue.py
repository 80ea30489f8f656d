"""FIFO queues: messages (queue, id, data, created_at, delay_until, retry_count, state) and their transitions.

State is ready, in_flight or done. Order within a queue: created_at, then id. A message is visible from delay_until on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH_MOST, PUSH_MOST = 100, 5000  # messages of one pop, and of one list that is pushed


def push(messages: DataFrame, new: DataFrame, now: Column, delay_seconds: int = 0) -> DataFrame:
    """Adds rows of queue, id, data (created_at if given) as ready messages."""
    rows = new if "created_at" in new.columns else new.withColumn("created_at", now)
    rows = rows.withColumn("delay_until", F.col("created_at") + F.make_dt_interval(secs=F.lit(delay_seconds)) if delay_seconds else F.lit(None).cast(messages.schema["delay_until"].dataType))
    rows = rows.withColumn("retry_count", F.lit(0)).withColumn("state", F.lit("ready"))
    return messages.unionByName(rows.select(*messages.columns))


def visible(messages: DataFrame, now: Column) -> DataFrame:
    return messages.where((F.col("state") == "ready") & (F.col("delay_until").isNull() | (F.col("delay_until") <= now)))


def heads(messages: DataFrame, now: Column, n: int) -> DataFrame:
    """The first n visible messages of every queue, with their place `pos` from 1. Spark keeps n rows of a queue per task before the shuffle."""
    w = Window.partitionBy("queue").orderBy("created_at", "id")
    return visible(messages, now).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def peek(messages: DataFrame, queue: str, now: Column, n: int = 10) -> DataFrame:
    """Does not change the queue; a sorted limit."""
    return visible(messages, now).where(F.col("queue") == queue).orderBy("created_at", "id").limit(n)


def pop(messages: DataFrame, now: Column, n: int = 1, consumer: str | None = None, queue: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(popped, messages): the first n (at most 100) of each queue, or of one, become in_flight."""
    given = messages if queue is None else messages.where(F.col("queue") == queue)
    popped = heads(given, now, min(n, BATCH_MOST))
    after = messages.join(popped.select("queue", "id", F.lit(True).alias("__hit")), ["queue", "id"], "left")
    after = after.withColumn("state", F.when(F.col("__hit"), "in_flight").otherwise(F.col("state")))
    if consumer is not None and "consumer_id" in messages.columns:
        after = after.withColumn("consumer_id", F.when(F.col("__hit"), F.lit(consumer)).otherwise(F.col("consumer_id")))
    return popped, after.select(*messages.columns)


def ack(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages without the acknowledged ones; unknown ids don't matter."""
    return messages.join(ids.select("id"), "id", "left_anti").select(*messages.columns)


def nack(messages: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Back to ready, one more retry, visible after as many seconds as there were retries."""
    hit = messages.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    again = F.col("retry_count") + 1
    changed = hit.withColumn("delay_until", F.when(F.col("__hit"), now + F.make_dt_interval(secs=again)).otherwise(F.col("delay_until")))
    changed = changed.withColumn("state", F.when(F.col("__hit"), "ready").otherwise(F.col("state"))).withColumn("retry_count", F.when(F.col("__hit"), again).otherwise(F.col("retry_count")))
    return changed.select(*messages.columns)


def stats(messages: DataFrame) -> DataFrame:
    """queue, size (ready), pending (in_flight), processed (not ready), retried."""
    n = lambda c: F.count_if(c)
    state = F.col("state")
    return messages.groupBy("queue").agg(n(state == "ready").alias("size"), n(state == "in_flight").alias("pending"), n(state != "ready").alias("processed"), n(F.col("retry_count") > 0).alias("retried"))


def names(messages: DataFrame) -> DataFrame:
    """Queues with at least one ready message."""
    return messages.where("state = 'ready'").select("queue").distinct()


def purge(messages: DataFrame, queue: str) -> DataFrame:
    return messages.where(F.col("queue") != queue)
