"""Consumers of a log as streaming queries. The checkpoint of a query holds what a group has committed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def subscribe(spark: SparkSession, path: str, schema: T.StructType, topic: str | None = None, partitions: list[int] | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the records in a folder, of one topic and some partitions (those a member is assigned) if given."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if topic is not None:
        df = df.where(F.col("topic") == topic)
    return df.where(F.col("partition").isin(partitions)) if partitions is not None else df


def consume(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls handler(batch, number) for each micro-batch. A batch is committed after the handler returned: at least once; if it raises, the batch comes again."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def deduplicated(stream: DataFrame, key: str = "idempotency_key", within: str = "24 hours", time: str = "timestamp") -> DataFrame:
    """The first record of each (topic, key) within a time; its state is dropped after that. Times become TIMESTAMP, as watermarks need."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark(["topic", key])


def sink_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet files, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def partition_counts(stream: DataFrame) -> DataFrame:
    """Records and latest offset of each (topic, partition) so far, as a streaming aggregate."""
    return stream.groupBy("topic", "partition").agg(F.count("*").alias("messages"), F.max("offset").alias("latest_offset"))
