"""The key-value model: a log of mutations (key, value, seq, op, expires_at, by) and views of it.

op is SET, DEL, EXPIRE or INCR. SET and DEL start a key anew, INCR adds to its number, EXPIRE sets its time; expired keys are absent. `now` is a
parameter everywhere. A log without INCR needs no column `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import glob


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last row of each key: one shuffle, partly aggregated before it."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("__row")).select(key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def alive(expires_at: Column, now: Column) -> Column:
    return expires_at.isNull() | (expires_at > now)


def _number(value: Column) -> Column:
    """A text that reads as a whole number, as such; else null."""
    return F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("long"))


def _delta(log: DataFrame) -> Column:
    """What an INCR adds: `by`, or 1 if that is 0 or null."""
    return F.when(F.coalesce("by", F.lit(0)) == 0, 1).otherwise(F.col("by")) if "by" in log.columns else F.lit(1)


def view(log: DataFrame, now: Column | None = None) -> DataFrame:
    """key, value, expires_at of the keys that are there at `now` (None: whatever their expiry).

    After the last SET or DEL of a key: INCR adds to the number (0 without one, or if the value is no whole number) and keeps the expiry;
    the last EXPIRE replaces the expiry, if the key was there at the time.
    """
    start = log.where("op IN ('SET', 'DEL')").groupBy("key").agg(F.max_by(F.struct("op", "value", "expires_at", "seq"), "seq").alias("s"))
    later = log.where("op IN ('INCR', 'EXPIRE')").withColumn("d", _delta(log)).join(start, "key", "left").where("s IS NULL OR seq > s.seq")
    is_incr = F.col("op") == "INCR"
    later = later.groupBy("key").agg(
        F.count_if(is_incr).alias("n"), F.sum(F.when(is_incr, F.col("d"))).cast("long").alias("d"), F.min(F.when(is_incr, F.col("seq"))).alias("born"),
        F.max_by(F.struct("expires_at", "seq"), F.when(~is_incr, F.col("seq"))).alias("e"),
    )
    both = start.join(later, "key", "full")
    is_set, counted = F.coalesce(F.col("s.op") == "SET", F.lit(False)), F.coalesce(F.col("n") > 0, F.lit(False))
    base = F.coalesce(_number(F.when(is_set, F.col("s.value"))), F.lit(0))
    value = F.when(counted, (base + F.col("d")).cast("string")).otherwise(F.col("s.value"))
    expiry = F.when(F.col("e.seq") > F.when(is_set, F.col("s.seq")).otherwise(F.col("born")), F.col("e.expires_at")).otherwise(F.when(is_set, F.col("s.expires_at")))
    there = both.where(is_set | counted).select("key", value.alias("value"), expiry.alias("expires_at"))
    return there if now is None else there.where(alive(F.col("expires_at"), now))


def get(kv: DataFrame, key: str) -> DataFrame:
    return kv.where(F.col("key") == key)


def exists(kv: DataFrame, keys: list[str]) -> DataFrame:
    asked = kv.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    found = kv.where(F.col("key").isin(keys)).select("key", F.lit(True).alias("found"))
    return asked.join(found, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def mget(kv: DataFrame, keys: list[str]) -> DataFrame:
    """pos, key, value in the order asked; keys asked twice come twice, missing ones not at all."""
    asked = kv.sparkSession.createDataFrame(list(enumerate(keys)), "pos int, key string")
    return asked.join(kv.where(F.col("key").isin(keys)), "key").select("pos", "key", "value").orderBy("pos")


def keys(kv: DataFrame, pattern: str = "*", limit: int = 1000) -> DataFrame:
    """Keys that fit a pattern, in order; limit 0: all."""
    out = kv.where(glob(F.col("key"), pattern)).select("key").orderBy("key")
    return out.limit(limit) if limit else out


def delete_keys(kv: DataFrame, names: list[str]) -> DataFrame:
    return kv.where(~F.col("key").isin(names))


def delete_pattern(kv: DataFrame, pattern: str) -> DataFrame:
    return kv.where(~glob(F.col("key"), pattern))


def ttl(kv: DataFrame, now: Column) -> DataFrame:
    """Whole seconds left of each key; -1 without an expiry."""
    left = F.floor((F.unix_micros(F.col("expires_at").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000)
    return kv.select("key", F.coalesce(left, F.lit(-1)).cast("long").alias("ttl"))


def counter_totals(log: DataFrame, now: Column | None = None) -> DataFrame:
    """key, value of the keys whose value is a whole number."""
    return view(log, now).select("key", _number(F.col("value")).alias("value")).where("value IS NOT NULL")


def counter_running(log: DataFrame, seqs_per_range: int = 1 << 20) -> DataFrame:
    """The rows of INCR with `value`, the counter after each.

    Numbers of the log are cut into ranges, and a key's rows into those of each range: so a task's group has at most seqs_per_range rows, however hot
    the key. A range hands on the sum since the last SET or DEL in it, or, without one, adds to what came before.
    """
    fresh = F.col("op").isin("SET", "DEL")
    step = F.when(fresh, F.when(F.col("op") == "SET", F.coalesce(_number(F.col("value")), F.lit(0))).otherwise(0)).when(F.col("op") == "INCR", _delta(log)).otherwise(0).cast("long")
    rows = log.withColumn("__range", F.floor(F.col("seq") / seqs_per_range)).withColumn("__step", step).withColumn("__fresh", fresh.cast("int"))
    inside = Window.partitionBy("key", "__range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__since", F.sum("__fresh").over(inside))
    since = Window.partitionBy("key", "__range", "__since").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.sum("__step").over(since))
    ends = log.withColumn("__range", F.floor(F.col("seq") / seqs_per_range)).withColumn("__step", step)
    last = ends.where(fresh).groupBy("key", "__range").agg(F.max("seq").alias("__last"))
    ends = ends.join(last, ["key", "__range"], "left").where("__last IS NULL OR seq >= __last").groupBy("key", "__range").agg(F.sum("__step").alias("__tail"), F.max(F.col("__last").isNotNull().cast("int")).alias("__had"))
    over = Window.partitionBy("key").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("__part", F.sum("__had").over(over))
    so_far = F.sum("__tail").over(Window.partitionBy("key", "__part").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("__so_far", so_far)
    carried = ends.select("key", "__range", F.lag("__so_far", 1, 0).over(Window.partitionBy("key").orderBy("__range")).alias("__carry"))
    value = F.col("__own") + F.when(F.col("__since") == 0, F.col("__carry")).otherwise(0)
    return rows.where("op = 'INCR'").join(carried, ["key", "__range"]).withColumn("value", value).select(*log.columns, *(["value"] if "value" not in log.columns else []))


def compact(log: DataFrame, now: Column) -> DataFrame:
    """A log of one SET for each key that is there at `now`, counters with their number: it reads as the old one, from then on too."""
    return view(log, now).select("key", "value", F.lit(0).cast("long").alias("seq"), F.lit("SET").alias("op"), "expires_at")
