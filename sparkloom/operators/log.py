"""Partitioned append-only logs: (topic, partition, offset, timestamp, partition_key, data, headers), consumers, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import partition_of

MOST_BYTES = 10 * 1024 * 1024
READ_DEFAULT = 10
PUBLISH_MOST = 10_000  # records of one list that is published
# Fixed value: the header of a producer's key for one record.
IDEMPOTENCY_HEADER = "x-idempotency-key"


def reject_reason(topic: Column, data: Column) -> Column:
    """Why a record can't be published, or null."""
    return F.when(topic.isNull() | (topic == ""), "empty topic").when(data.isNull() | (F.octet_length(data) == 0), "empty data").when(F.octet_length(data) > MOST_BYTES, "too large")


def publish(records: DataFrame, partitions: int, base: DataFrame | None = None, order: tuple[str, ...] = ("timestamp", "seq"), slices: int = 1) -> DataFrame:
    """Adds partition (by key, or by turns) and offset: gapless in each (topic, partition), after `base` (topic, partition, next_offset).

    slices: the number of equal times that the records of a partition are cut into, so that a partition, however hot, is numbered by so many tasks (as far as its
    records are spread over time). The first column of `order` must then be a time. One slice for every few million records of the largest partition will do.
    """
    out = records.withColumn("partition", partition_of(F.col("partition_key"), partitions, F.col("seq")))
    if slices > 1:
        at = F.unix_micros(F.col(order[0]).cast("timestamp"))
        ends = records.agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
        out = out.join(F.broadcast(ends), how="cross")  # one row
        out = out.withColumn("__slice", F.coalesce(F.floor((at - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1) * slices), F.lit(-1))).drop("__lo", "__hi")
        sizes = out.groupBy("topic", "partition", "__slice").agg(F.count("*").alias("__rows"))
        lower = Window.partitionBy("topic", "partition").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("topic", "partition", "__slice", F.coalesce(F.sum("__rows").over(lower), F.lit(0)).alias("__before"))
        place = F.row_number().over(Window.partitionBy("topic", "partition", "__slice").orderBy(*order))
        out = out.withColumn("__place", place).join(sizes, ["topic", "partition", "__slice"])
        out = out.withColumn("offset", F.col("__before") + F.col("__place") - 1).select(*records.columns, "partition", "offset")
    else:
        w = Window.partitionBy("topic", "partition").orderBy(*order)
        out = out.withColumn("offset", F.row_number().over(w).cast("long") - 1)
    if base is None:
        return out
    out = out.join(base.select("topic", "partition", "next_offset"), ["topic", "partition"], "left")
    return out.withColumn("offset", F.col("offset") + F.coalesce("next_offset", F.lit(0))).drop("next_offset")


def with_idempotency_keys(records: DataFrame, headers: str = "headers") -> DataFrame:
    """Records without the header of an idempotency key get a UUID there; `deduplicate` by it makes a record that was published again count once."""
    own = F.create_map(F.lit(IDEMPOTENCY_HEADER), F.uuid())
    held = F.coalesce(F.col(headers), F.create_map().cast("map<string,string>"))
    return records.withColumn(headers, F.when(F.map_contains_key(held, F.lit(IDEMPOTENCY_HEADER)), held).otherwise(F.map_concat(held, own)))


def expire(log: DataFrame, now: Column) -> DataFrame:
    """Without messages whose header `ttl` (such as 1h30m, 10s, 250ms) has run out; an invalid ttl is no ttl."""
    text = F.element_at("headers", F.lit("ttl"))
    unit = lambda u: F.coalesce(F.regexp_extract(text, rf"(?:^|[a-z])(\d+(?:\.\d+)?){u}(?![a-z])", 1).try_cast("double"), F.lit(0.0))
    seconds = unit("h") * 3600 + unit("m") * 60 + unit("s") + unit("ms") / 1000
    valid = text.rlike(r"^(\d+(\.\d+)?(h|m|s|ms))+$")
    gone = valid & (F.unix_micros(F.col("timestamp").cast("timestamp")) + seconds * 1_000_000 <= F.unix_micros(now.cast("timestamp")))
    return log.where(~F.coalesce(gone, F.lit(False)))


def read(log: DataFrame, topic: str, partition: int, offset: int = 0, limit: int = READ_DEFAULT) -> DataFrame:
    """From an offset on; topic and partition prune directories, offset prunes row groups. A negative offset raises ValueError."""
    if offset < 0:
        raise ValueError("negative offset")
    return log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= offset)).orderBy("offset").limit(limit)


def read_from(log: DataFrame, topic: str, partition: int, timestamp: Column, limit: int = READ_DEFAULT) -> DataFrame:
    return log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("timestamp") >= timestamp)).orderBy("offset").limit(limit)


def read_batch(log: DataFrame, topic: str, partitions: list[int], offset: int = 0, limit: int = READ_DEFAULT) -> DataFrame:
    """The first `limit` records from an offset on, of each of some partitions."""
    rows = log.where((F.col("topic") == topic) & F.col("partition").isin(partitions) & (F.col("offset") >= offset))
    w = Window.partitionBy("partition").orderBy("offset")
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def read_latest(log: DataFrame, topic: str, partition: int, n: int = READ_DEFAULT) -> DataFrame:
    return log.where((F.col("topic") == topic) & (F.col("partition") == partition)).orderBy(F.desc("offset")).limit(n).orderBy("offset")


def latest_offsets(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition").agg(F.max("offset").alias("latest_offset"))


def next_offset(page: DataFrame, from_offset: int) -> DataFrame:
    """One row: where to read on after a page; the same place if it is empty."""
    return page.agg(F.coalesce(F.max("offset") + 1, F.lit(from_offset)).alias("next_offset"))


def topic_info(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition").agg(F.count("*").alias("messages"), (F.max("offset") + 1).alias("next_offset"))


def purge(log: DataFrame, topic: str) -> DataFrame:
    return log.where(F.col("topic") != topic)


def replicas(topic: str, partitions: int, nodes: list[str], factor: int, spark) -> DataFrame:
    """partition, leader, replicas: leaders by turns, replicas are the next nodes around."""
    all_nodes, n = F.array(*map(F.lit, nodes)), len(nodes)
    at = lambda i: F.get(all_nodes, (i % n).cast("int"))
    p = F.col("id")
    return spark.range(partitions).select(
        F.lit(topic).alias("topic"), p.cast("int").alias("partition"), at(p).alias("leader"), F.transform(F.sequence(F.lit(0), F.lit(min(factor, n) - 1)), lambda k: at(p + k)).alias("replicas")
    )


def commit(offsets: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("topic", "consumer", "partition")) -> DataFrame:
    """Offsets with those of `new` in place of theirs: seek of a consumer, commit of a group."""
    return offsets.join(new.select(*keys), list(keys), "left_anti").select(*offsets.columns).unionByName(new.select(*offsets.columns))


def assignment(members: DataFrame, partitions: int) -> DataFrame:
    """group, partition, member: partition p goes to member p modulo their number, members in order. Members of a group are few."""
    rows = members.groupBy("group").agg(F.array_sort(F.collect_set("member")).alias("m"))
    return rows.select("group", "m", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition")).select("group", "partition", F.get("m", F.col("partition") % F.size("m")).alias("member"))


def live_members(heartbeats: DataFrame, now: Column, timeout_seconds: int = 10) -> DataFrame:
    """group, member with a heartbeat within the timeout."""
    last = heartbeats.groupBy("group", "member").agg(F.max("at").alias("at"))
    return last.where(F.unix_micros(F.col("at").cast("timestamp")) + timeout_seconds * 1_000_000 > F.unix_micros(now.cast("timestamp"))).select("group", "member")


def lag(log: DataFrame, committed: DataFrame) -> DataFrame:
    """topic, group, partition, committed, next_offset, lag."""
    ends = log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
    return committed.join(ends, ["topic", "partition"], "left").select("topic", "group", "partition", "committed", F.coalesce("next_offset", F.lit(0)).alias("next_offset"), (F.coalesce("next_offset", F.lit(0)) - F.col("committed")).alias("lag"))


def deduplicate(log: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """The first record of each (topic, key), and all records without a key. Expiring keys: streaming.consume.deduplicated."""
    rows = log.where(F.col(key).isNotNull())
    rest = [c for c in log.columns if c not in ("topic", key)]
    first = rows.groupBy("topic", key).agg(F.min_by(F.struct(*rest), F.struct("timestamp", "offset", "partition")).alias("__r")).select("topic", key, *(F.col(f"__r.{c}").alias(c) for c in rest))
    return first.select(*log.columns).unionByName(log.where(F.col(key).isNull()))
