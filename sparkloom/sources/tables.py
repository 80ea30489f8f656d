"""Parquet tables, and the views of `events` as a key-value log, a queue and a partitioned log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kv_log(events: DataFrame) -> DataFrame:
    """Every event sets event_type:user_id to its props, for a week."""
    return events.select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"), F.lit("SET").alias("op"),
        (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
    )


def queue_messages(events: DataFrame) -> DataFrame:
    """Every event is a ready message of the queue of its type."""
    return events.select(
        F.col("event_type").alias("queue"), F.col("event_id").alias("id"), F.col("props").alias("data"), F.col("ts").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("delay_until"), F.lit(0).alias("retry_count"), F.lit("ready").alias("state"),
    )


def log_records(events: DataFrame) -> DataFrame:
    """Every event is a record of topic `events`, keyed by its user."""
    return events.select(
        F.lit("events").alias("topic"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("partition_key"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"), F.col("props").alias("data"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"),
    )


def write_log(log: DataFrame, path: str) -> None:
    """Append a log, laid out so that topic and partition prune directories."""
    log.repartition("topic", "partition").sortWithinPartitions("offset").write.mode("append").partitionBy("topic", "partition").parquet(path)


def backup(df: DataFrame, path: str) -> None:
    """A full copy of a collection, queue or log; an existing copy there is an error."""
    df.write.mode("errorifexists").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


