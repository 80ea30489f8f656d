"""The models by name, over catalog tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom import api
from sparkloom.sources import catalog

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS loomtest LOCATION '{tmp_path_factory.mktemp('db')}'")
    spark.sql("USE loomtest")
    yield spark
    spark.sql("USE default")
    spark.sql("DROP DATABASE loomtest CASCADE")


def test_collection(db):
    docs = db.createDataFrame([(1, "Ann", 30), (2, "Bob", 20), (3, "Cy", 40)], "_id long, name string, age long")
    catalog.create_collection(docs, "users", {"capped": "false"})
    with pytest.raises(ValueError):
        catalog.create_collection(docs, "users")
    users = api.Collection(db, "users")
    catalog.create_index(db, "users", "by_name", {"name": 1}, unique=True)
    assert [r.name for r in users.find({"age": {"$gte": 25}}, [("name", -1)]).collect()] == ["Cy", "Ann"]
    users.insert_one({"_id": 4, "name": "Di", "age": 25})
    with pytest.raises(ValueError):
        users.insert_one({"_id": 5, "name": "Di"})
    users.update_many({"age": {"$lt": 26}}, {"$inc": {"age": 1}})
    users.delete_one({"name": "Cy"})
    assert users.bulk_write([{"update_one": {"spec": {"_id": 1}, "update": {"$set": {"name": "Anna"}}}}]) == []
    assert {(r._id, r.name, r.age) for r in users.rows.collect()} == {(1, "Anna", 30), (2, "Bob", 21), (4, "Di", 26)}
    assert users.count() == 3 and catalog.list_indexes(db, "users")["by_name"]["unique"] and catalog.options(db, "users") == {"capped": "false"}
    users.update_many({"name": "Bob"}, {"$set": {"city": "Oslo"}, "$inc": {"age": 0.5}})  # a new column, and a type that changes
    assert {(r.name, r.age, r.city) for r in users.rows.collect()} == {("Anna", 30, None), ("Bob", 21.5, "Oslo"), ("Di", 26, None)}
    assert catalog.list_indexes(db, "users")["by_name"]["unique"] and catalog.options(db, "users") == {"capped": "false"}
    catalog.drop_index(db, "users", "by_name")
    assert catalog.list_indexes(db, "users") == {} and "users" in catalog.list_collections(db)
    catalog.drop_collection(db, "users")
    catalog.drop_collection(db, "users")
    assert "users" not in catalog.list_collections(db)


def test_key_value(db):
    store = api.KeyValue(db, "kvlog")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    store.set("test_key", "test_value", T0, ttl=300)
    store.mset({"mset_test1": "value1", "mset_test2": "value2"})
    store.incr("counter", 5)
    store.incr("counter", 3)
    store.decr("counter", 1)
    assert store.get("test_key", T0).first().value == "test_value" and store.get("test_key", at(300)).count() == 0
    assert 0 < {r.key: r.ttl for r in store.ttl(at(1)).collect()}["test_key"] <= 300
    store.expire("mset_test1", 10, T0)
    store.delete("mset_test2", "none")
    assert [r.key for r in store.keys(at(5)).collect()] == ["counter", "mset_test1", "test_key"]
    assert store.counters().where("key = 'counter'").first().value == 7 and store.get("counter", T0).first().value == "7"
    store.compact(at(5))
    assert [r.key for r in store.keys(at(5)).collect()] == ["counter", "mset_test1", "test_key"]
    store.incr("counter", 1)
    assert store.get("counter", at(5)).first().value == "8"
    store.delete_pattern("mset*", at(5))
    assert [r.key for r in store.keys(at(5)).collect()] == ["counter", "test_key"]
    store.delete("counter")
    store.incr("counter", 1)
    assert store.get("counter", at(5)).first().value == "1"
    store.incr("n", 7)
    store.set("n", "10", T0)
    store.compact(at(5))
    assert store.get("n", at(5)).first().value == "10"
    with pytest.raises(ValueError):
        store.set("", "x", T0)


def test_queues(db):
    q = api.Queues(db, "queues")
    q.push(db.createDataFrame([("q", f"{i}", f"msg{i}", T0 + dt.timedelta(seconds=i)) for i in range(1, 6)], "queue string, id string, data string, created_at timestamp"), T0)
    assert [r.data for r in q.peek("q", T0, 1).collect()] == ["msg1"]
    assert [r.data for r in q.pop("q", T0, 2, "me")] == ["msg1", "msg2"]
    q.ack(["1"])
    q.nack(["2"], T0)
    assert [r.data for r in q.pop("q", T0, 100)] == ["msg3", "msg4", "msg5"]
    assert [r.data for r in q.pop("q", T0 + dt.timedelta(seconds=1))] == ["msg2"]
    s = q.stats().first()
    assert (s["size"], s.pending) == (0, 4)
    with pytest.raises(ValueError):
        q.nack(["2", "nothing"], T0)
    q.purge("q")
    assert q.messages.count() == 0
    q.push_batch("b", [("x", "1"), ("y", "2")], T0)
    assert [r.id for r in q.peek("b", T0 + dt.timedelta(seconds=1)).collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        q.push_batch("b", [(str(i), "d") for i in range(5001)], T0)


def test_topic(db):
    t = api.Topic.create(db, "topic_a", 2)
    with pytest.raises(ValueError):
        api.Topic.create(db, "topic_a", 2)
    records = db.createDataFrame([(f"k{i}", T0, i, f"m{i}", {"source": "s"}) for i in range(6)], "partition_key string, timestamp timestamp, seq long, data string, headers map<string,string>")
    t.publish(records)
    t.publish(records.withColumn("seq", F.col("seq") + 6))
    rows = t.rows.collect()
    for p in range(2):
        assert sorted(r.offset for r in rows if r.partition == p) == list(range(sum(r.partition == p for r in rows)))
    assert len(rows) == 12 and t.read(0, 1, 2).first().headers == {"source": "s"}
    with pytest.raises(ValueError):
        t.publish(records.withColumn("data", F.lit("")))
    t.purge()
    t.publish(records)
    assert min(r.offset for r in t.rows.collect()) == 0 and t.partitions == 2
    t.drop()


def test_consumers_and_groups(db):
    t = api.Topic.create(db, "topic_g", 3)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    assert "topic_g" in api.Topic.names(db) and "topic_g" not in catalog.list_collections(db)
    t.publish_batch([(f"k{i}", f"m{i}", {"ttl": "5s"} if i == 0 else None) for i in range(20)], T0)
    with pytest.raises(ValueError):
        t.publish_batch([("k", "m", None)] * 10_001, T0)
    assert t.offset("c", 1) == 0
    t.seek("c", 1, 7)
    t.seek("c", 1, 3)
    assert t.offset("c", 1) == 3 and t.offset("c", 0) == 0
    for m in "ba":
        t.join("g", m, at(1))
    t.join("g", "late", at(-20))
    assert {r.member for r in t.members("g", at(2)).collect()} == {"a", "b"}
    owner = {r.partition: r.member for r in t.assignment("g", at(2)).collect()}
    assert owner == {0: "a", 1: "b", 2: "a"}
    seen = {(r.partition, r.offset) for m in "ab" for r in t.poll("g", m, at(2), 100).collect()}
    assert len(seen) == 20 and len([r for m in "ab" for r in t.poll("g", m, at(9), 100).collect()]) == 19
    ends = {p: max(o for q, o in seen if q == p) + 1 for p in range(3)}
    for p, end in ends.items():
        t.commit("g", p, end - 1)
    assert {r.partition: r.lag for r in t.lag("g").collect()} == dict.fromkeys(range(3), 1)
    assert [r.offset for r in t.poll("g", "b", at(2)).collect()] == [ends[1] - 1]
    t.leave("g", "a", at(3))
    assert {r.member for r in t.members("g", at(3)).collect()} == {"b"}
    records = db.createDataFrame([("k", at(4), 1000 + i, f"p{i}", {"a": "b"} if i else None) for i in range(3)], "partition_key string, timestamp timestamp, seq long, data string, headers map<string,string>")
    t.produce(records)
    made = t.rows.where("data like 'p%'")
    assert made.where("headers['x-idempotency-key'] IS NULL").count() == 0
    t.publish(made.select("partition_key", "timestamp", "seq", "data", "headers"))  # the same again
    assert t.rows.count() == 26 and t.once().count() == 23
    t.drop()
    assert "topic_g" not in api.Topic.names(db)
