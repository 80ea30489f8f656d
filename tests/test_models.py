"""Keys, queues, logs and streams."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.keys import fnv1a, glob, partition_of
from sparkloom.operators import kv, log, queue
from sparkloom.sources import tables
from sparkloom.streaming import consume

T0 = dt.datetime(2024, 1, 1)
# FNV-1a 32 of some keys.
HASHES = {"user123": 122042374, "us-east": 2928563881, "us-west": 1064861643, "eu-central": 4038913095, "cust_001": 1647785482, "warehouse_b": 3410090233, "office": 2861480497, "": 2166136261, "user_12345": 725725142}


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def now(seconds=0):
    return F.lit(at(seconds)).cast("timestamp_ntz")


def test_fnv(spark):
    df = spark.createDataFrame([(k,) for k in HASHES], "k string")
    assert {r.k: r.h for r in df.select("k", fnv1a(F.col("k")).alias("h")).collect()} == HASHES
    parts = {r.k: r.p for r in df.select("k", partition_of(F.col("k"), 4, F.lit(6)).alias("p")).collect()}
    assert parts == {k: 2 if k == "" else h % 4 for k, h in HASHES.items()}


@pytest.mark.parametrize("pattern,want", [("ab*b", {"ab", "abxb"}), ("a_b", {"a_b"}), ("*b", {"ab", "a_b", "a%b", "abxb"}), ("a*b*c", {"ab", "a_b", "a%b", "abxb", "acc"}), ("*", {"ab", "a_b", "a%b", "abxb", "acc"}), ("ab", {"ab"})])
def test_glob(spark, pattern, want):
    df = spark.createDataFrame([(k,) for k in ("ab", "a_b", "a%b", "abxb", "acc")], "k string")
    assert {r.k for r in df.where(glob(F.col("k"), pattern)).collect()} == want


def kv_rows(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, seq long, op string, expires_at timestamp_ntz")


def test_kv_view(spark):
    rows = [("a", "1", 1, "SET", None), ("a", "2", 2, "SET", at(10)), ("b", "1", 3, "SET", at(5)), ("c", "1", 4, "SET", None), ("c", None, 5, "DEL", None), ("d", "1", 6, "SET", None), ("d", None, 7, "EXPIRE", at(3)), ("e", None, 8, "EXPIRE", at(50)), ("f", "1", 9, "SET", at(1)), ("f", "2", 10, "SET", None)]
    df = kv_rows(spark, rows)
    got = lambda s: {r.key: r.value for r in kv.view(df, now(s)).collect()}
    assert got(0) == {"a": "2", "b": "1", "d": "1", "f": "2"} and got(5) == {"a": "2", "f": "2"} and got(10) == {"f": "2"}
    left = {r.key: r.ttl for r in kv.ttl(kv.view(df, now(0)), F.lit(dt.datetime(2024, 1, 1, 0, 0, 0, 500000)).cast("timestamp_ntz")).collect()}
    assert left == {"a": 9, "b": 4, "d": 2, "f": -1}
    view = kv.view(df, now(0))
    assert [(r.pos, r.key, r.value) for r in kv.mget(view, ["f", "x", "a", "f"]).collect()] == [(0, "f", "2"), (2, "a", "2"), (3, "f", "2")]
    assert {r.key: r.found for r in kv.exists(view, ["a", "x"]).collect()} == {"a": True, "x": False}
    assert [r.key for r in kv.keys(view, "*", 2).collect()] == ["a", "b"]
    assert {r.key for r in kv.delete_pattern(view, "a*").collect()} == {"b", "d", "f"} and kv.get(view, "a").count() == 1
    assert {r.key: r.value for r in kv.view(kv.compact(df, now(5)), now(5)).collect()} == got(5)


def test_counters(spark):
    rows = [("c", 1, "INCR", None, 5), ("c", 2, "INCR", None, 3), ("d", 3, "INCR", None, 10), ("d", 4, "INCR", None, -3), ("t", 5, "SET", "text", None), ("t", 6, "INCR", None, 0), ("s", 7, "INCR", None, 9), ("s", 8, "SET", "40", None), ("s", 9, "INCR", None, 2)]
    df = spark.createDataFrame(rows, "key string, seq long, op string, value string, by long").withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    assert {r.key: r.value for r in kv.counter_totals(df).collect()} == {"c": 8, "d": 7, "t": 1, "s": 42}
    many = spark.range(200).select(F.lit("global").alias("key"), F.col("id").alias("seq"), F.lit("INCR").alias("op"), F.lit(None).cast("string").alias("value"), F.lit(1).cast("long").alias("by"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    assert kv.counter_totals(many).first().value == 200
    assert [r.value for r in kv.counter_running(many, 7).orderBy("seq").collect()] == list(range(1, 201))


def replay(rows, when):
    """A mixed log one row after the other: the keys at a time, and the counter after each INCR."""
    held, running = {}, []
    for key, seq, op, value, by, expires in rows:
        if op == "SET":
            held[key] = [value, expires]
        elif op == "DEL":
            held.pop(key, None)
        elif op == "EXPIRE" and key in held:
            held[key][1] = expires
        elif op == "INCR":
            old = held.setdefault(key, ["0", None])
            old[0] = str((int(old[0]) if re.fullmatch("[+-]?[0-9]+", old[0] or "") else 0) + (by or 1))
            running.append((key, seq, int(old[0])))
    return {k: (v, e) for k, (v, e) in held.items() if e is None or e > when}, running


@pytest.mark.parametrize("seed", range(3))
def test_mixed_log_reads_as_replayed(spark, seed):
    r = random.Random(seed)
    rows = []
    for seq in range(1, 400):
        op = r.choice(["SET", "DEL", "EXPIRE", "INCR", "INCR", "INCR", "GET"])
        value = r.choice(["12", "-3", "text", "", "5.0", " 7"]) if op == "SET" else None
        rows.append((r.choice("abcdefgh"), seq, op, value, r.choice([0, 1, 5, -2]) if op == "INCR" else None, at(r.randint(1, 9)) if op == "EXPIRE" or (op == "SET" and r.random() < 0.3) else None))
    df = spark.createDataFrame(rows, "key string, seq long, op string, value string, by long, expires_at timestamp_ntz")
    want, running = replay(rows, at(5))
    assert {x.key: (x.value, x.expires_at) for x in kv.view(df, F.lit(at(5)).cast("timestamp_ntz")).collect()} == want
    assert sorted((x.key, x.seq, x.value) for x in kv.counter_running(df, 37).collect()) == sorted(running)
    packed = kv.compact(df, F.lit(at(5)).cast("timestamp_ntz"))
    assert {x.key: (x.value, x.expires_at) for x in kv.view(packed).collect()} == want


def messages(spark, n=5):
    rows = [("q", i, f"msg{i}", at(i), None, 0, "ready", None) for i in range(1, n + 1)] + [("r", 100, "other", at(0), None, 0, "ready", None)]
    return spark.createDataFrame(rows, "queue string, id long, data string, created_at timestamp_ntz, delay_until timestamp_ntz, retry_count int, state string, consumer_id string")


def test_queue(spark):
    m = messages(spark)
    assert [r.data for r in queue.peek(m, "q", now(), 2).collect()] == ["msg1", "msg2"]
    popped, after = queue.pop(m, now(), 2, "me", "q")
    assert [r.id for r in popped.orderBy("pos").collect()] == [1, 2]
    assert {r.id: r.consumer_id for r in after.collect()} == {1: "me", 2: "me", 3: None, 4: None, 5: None, 100: None}
    s = {r.queue: r for r in queue.stats(after).collect()}
    assert (s["q"]["size"], s["q"].pending, s["q"].processed) == (3, 2, 2)
    rest = queue.ack(after, popped.where("id = 1"))
    assert {r.id for r in rest.collect()} == {2, 3, 4, 5, 100}
    again = queue.nack(rest, popped.where("id = 2"), now(60))
    twice = queue.nack(again, popped.where("id = 2"), now(100))
    assert [(r.delay_until, r.retry_count, r.state) for r in again.where("id = 2").collect()] == [(at(61), 1, "ready")]
    assert [(r.delay_until, r.retry_count) for r in twice.where("id = 2").collect()] == [(at(102), 2)]
    assert [r.id for r in queue.peek(again, "q", now(60)).collect()] == [3, 4, 5] and [r.id for r in queue.peek(again, "q", now(61)).collect()] == [2, 3, 4, 5]
    assert {r.queue for r in queue.names(m).collect()} == {"q", "r"} and {r.queue for r in queue.purge(m, "q").collect()} == {"r"}
    pushed = queue.push(m, spark.createDataFrame([("n", 7, "late")], "queue string, id long, data string").withColumn("consumer_id", F.lit(None).cast("string")), now(0), 30)
    assert queue.peek(pushed, "n", now(29)).count() == 0 and queue.peek(pushed, "n", now(30)).count() == 1


def records(spark, n=20, topic="t"):
    rows = [(topic, f"k{i % 5}", at(i), i, f"m{i}", f"key{i % 7}" if i % 4 else None) for i in range(n)]
    return spark.createDataFrame(rows, "topic string, partition_key string, timestamp timestamp_ntz, seq long, data string, idempotency_key string")


def test_log(spark):
    out = log.publish(records(spark), 3)
    rows = out.collect()
    for p in range(3):
        mine = sorted((r for r in rows if r.partition == p), key=lambda r: r.offset)
        assert [r.offset for r in mine] == list(range(len(mine))) and [r.seq for r in mine] == sorted(r.seq for r in mine)
    info = {r.partition: r for r in log.topic_info(out).collect()}
    assert sum(r.messages for r in info.values()) == 20
    base = out.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
    more = log.publish(records(spark, 5), 3, base)
    assert all(r.offset >= info[r.partition].next_offset for r in more.collect() if r.partition in info)
    p = rows[0].partition
    assert [r.offset for r in log.read(out, "t", p, 2, 2).collect()] == [2, 3] and log.read(out, "none", p).count() == 0
    with pytest.raises(ValueError):
        log.read(out, "t", 0, -1)
    assert all(r.timestamp >= at(9) for r in log.read_from(out, "t", p, now(9)).collect())
    assert log.next_offset(log.read(out, "t", p, 7000), 7000).first().next_offset == 7000
    assert [r.offset for r in log.read_latest(out, "t", p, 2).collect()] == [info[p].messages - 2, info[p].messages - 1]
    assert log.purge(out, "t").count() == 0
    first = {}
    for r in sorted(rows, key=lambda r: r.seq):
        first.setdefault(r.idempotency_key or r.seq, r.seq)
    assert {r.seq for r in log.deduplicate(out).collect()} == set(first.values())


def test_keyless_records_take_turns(spark):
    out = log.publish(records(spark).withColumn("partition_key", F.lit("")), 4)
    assert {r.partition: r["count"] for r in out.groupBy("partition").count().collect()} == {0: 5, 1: 5, 2: 5, 3: 5}


def test_publish_rules(spark):
    df = spark.createDataFrame([("t", "x"), ("", "x"), ("t", ""), ("t", None), (None, "x")], "t string, d string")
    assert [r[0] for r in df.select(log.reject_reason(F.col("t"), F.col("d"))).collect()] == [None, "empty topic", "empty data", "empty data", "empty topic"]
    big = spark.range(1).select(log.reject_reason(F.lit("t"), F.repeat(F.lit("x"), log.MOST_BYTES + 1)).alias("r"), log.reject_reason(F.lit("t"), F.repeat(F.lit("x"), log.MOST_BYTES)).alias("s")).first()
    assert (big.r, big.s) == ("too large", None)


def test_message_ttl(spark):
    df = spark.createDataFrame([(1, at(0), {"ttl": "1s"}), (2, at(0), {"ttl": "bad"}), (3, at(0), {}), (4, at(0), {"ttl": "1m30s"}), (5, at(0), {"ttl": "500ms"})], "id long, timestamp timestamp_ntz, headers map<string,string>")
    ids = lambda s: {r.id for r in log.expire(df, now(s)).collect()}
    assert ids(0) == {1, 2, 3, 4, 5} and ids(1) == {2, 3, 4} and ids(89) == {2, 3, 4} and ids(90) == {2, 3}


def test_groups(spark):
    members = spark.createDataFrame([("g", m) for m in "cab"], "group string, member string")
    assert {r.partition: r.member for r in log.assignment(members, 4).collect()} == {0: "a", 1: "b", 2: "c", 3: "a"}
    beats = spark.createDataFrame([("g", "a", at(0)), ("g", "b", at(0)), ("g", "a", at(8))], "group string, member string, at timestamp_ntz")
    assert {r.member for r in log.live_members(beats, now(10)).collect()} == {"a"}
    got = [(r.partition, r.leader, r.replicas) for r in log.replicas("t", 4, ["x", "y", "z"], 2, spark).orderBy("partition").collect()]
    assert got == [(0, "x", ["x", "y"]), (1, "y", ["y", "z"]), (2, "z", ["z", "x"]), (3, "x", ["x", "y"])]
    offsets = spark.createDataFrame([("t", "c", 0, 5), ("t", "c", 1, 6)], "topic string, consumer string, partition int, offset long")
    assert {(r.partition, r.offset) for r in log.commit(offsets, offsets.where("partition = 1").withColumn("offset", F.lit(2).cast("long"))).collect()} == {(0, 5), (1, 2)}


def test_log_on_disk_prunes(spark, tmp_path):
    tables.write_log(log.publish(records(spark), 3), f"{tmp_path}/log")
    page = log.read(spark.read.parquet(f"{tmp_path}/log"), "t", 1)
    assert "PartitionFilters: [isnotnull(topic" in page._jdf.queryExecution().toString()
    tables.backup(page, f"{tmp_path}/copy")
    assert tables.restore(spark, f"{tmp_path}/copy").count() == page.count()


def test_streams_equal_batches(spark, tmp_path):
    out = log.publish(records(spark), 3)
    out.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = lambda **k: consume.subscribe(spark, f"{tmp_path}/in", out.schema, "t", files_per_batch=1, **k)
    seen = []
    consume.consume(stream(partitions=[0, 1]), lambda df, n: seen.extend(r.seq for r in df.collect()), f"{tmp_path}/c1", once=True).awaitTermination()
    assert sorted(seen) == sorted(r.seq for r in out.where("partition < 2").collect())
    consume.consume(stream(partitions=[0, 1]), lambda df, n: seen.append("again"), f"{tmp_path}/c1", once=True).awaitTermination()
    assert "again" not in seen  # committed
    keyed = stream().where("idempotency_key is not null")
    consume.sink_parquet(consume.deduplicated(keyed).select("idempotency_key", "seq"), f"{tmp_path}/dedup", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/dedup").count() == out.select("idempotency_key").where("idempotency_key is not null").distinct().count()


def test_failed_batch_comes_again(spark, tmp_path):
    out = log.publish(records(spark), 1)
    out.coalesce(1).write.parquet(f"{tmp_path}/in")
    calls = []

    def handler(df, n):
        calls.append(df.count())
        if len(calls) == 1:
            raise RuntimeError("handler")

    for _ in range(2):
        q = consume.consume(consume.subscribe(spark, f"{tmp_path}/in", out.schema), handler, f"{tmp_path}/c", once=True)
        try:
            q.awaitTermination()
        except Exception:
            pass
    assert calls == [20, 20]
