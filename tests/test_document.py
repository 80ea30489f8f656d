"""The document model against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.filters import matches
from sparkloom.functions.values import NUMBER, python_text
from sparkloom.operators import document as doc

DOCS = [
    (1, "10", 10.0, True, ["a", "b"], (1, "x")), (2, " 1", 1.5, False, [], (2, None)), (3, "1d", -3.0, None, None, None), (4, "1e3", 1e22, True, ["a"], (1, "x")),
    (5, "Inf", None, False, ["b", "a"], (1, "y")), (6, None, 100.0, True, ["a", "b"], (3, "x")), (7, "apple", 0.5, None, ["c"], None), (8, "", 7.0, True, None, (1, "x")), (9, "9", 2.0, False, [], None),
]
SCHEMA = "_id long, s string, n double, b boolean, l array<string>, m struct<k: long, t: string>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3).cache()


def as_number(v):
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v)
    return float(v) if isinstance(v, str) and re.match(NUMBER, v) else None


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(b, dict):
        return a is not None and a.asDict() == b if hasattr(a, "asDict") else False
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    return type(a) is type(b) and a == b


def holds(row, spec):
    for field, want in spec.items():
        v = row[field] if field in row.__fields__ else None
        if v is None:
            return False
        ops = want if isinstance(want, dict) and want and all(k[0] == "$" for k in want) else {"$eq": want}
        for op, x in ops.items():
            if op == "$eq":
                ok = same(v, x)
            elif op == "$ne":
                ok = not same(v, x)
            elif op == "$in":
                ok = any(same(v, y) for y in x) if isinstance(x, list) else True
            elif op == "$nin":
                ok = not any(same(v, y) for y in x) if isinstance(x, list) else True
            else:
                p, q = as_number(v), as_number(x)
                p, q = (p, q) if p is not None and q is not None else (python_text(v), python_text(x))
                ok = {"$gt": p > q, "$gte": p >= q, "$lt": p < q, "$lte": p <= q}[op]
            if not ok:
                return False
    return True


VALUES = [10, 1, "10", "1e3", "apple", "", 100.0, True, False, -3, "b", " 1", 0.5, "9", 1e22]
SPECS = [{f: {op: v}} for f in ("s", "n") for op in ("$gt", "$gte", "$lt", "$lte", "$eq", "$ne") for v in VALUES if not (isinstance(v, bool) and op[1] in "gl")]
SPECS += [{"b": True}, {"b": {"$ne": True}}, {"missing": {"$ne": 1}}, {"n": 10}, {"s": {"$in": ["10", 9, None]}}, {"n": {"$in": []}}, {"n": {"$nin": []}}, {"s": {"$nin": ["10", None]}}, {"n": {"$in": 5}}]
SPECS += [{"l": ["a", "b"]}, {"l": []}, {"m": {"k": 1, "t": "x"}}, {"n": {"$gt": 1, "$lt": 50}, "b": True}, {}, {"b": {"$in": [True]}}, {"l": {"$in": [["a"], ["c"]]}}]


def test_filters(docs):
    rows = docs.collect()
    flags = docs.select("_id", *(F.coalesce(matches(s, docs.schema), F.lit(False)).alias(f"c{i}") for i, s in enumerate(SPECS))).collect()
    by = {r._id: r for r in flags}
    for i, s in enumerate(SPECS):
        got = {k for k, r in by.items() if r[f"c{i}"]}
        want = {r._id for r in rows if holds(r, s)}
        assert got == want, s


def test_unknown_operators_raise(docs):
    for s in ({"n": {"$regex": "x"}}, {"missing": {"$foo": 1}}):
        with pytest.raises(ValueError):
            matches(s, docs.schema)
    with pytest.raises(ValueError):
        doc.aggregate(docs, [{"$group": {}}])
    with pytest.raises(ValueError):
        doc.aggregate(docs, [{"$limit": 1, "$skip": 1}])


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("_id"), (F.col("id") * 2).alias("n"), F.lit("x").alias("wide")).write.parquet(f"{tmp_path}/t")
    plan = doc.find(spark.read.parquet(f"{tmp_path}/t"), {"n": {"$gt": 50}}, projection={"n": 1})._jdf.queryExecution().toString()
    assert "GreaterThan(n,50)" in plan and "wide" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("spec,columns", [
    ({"s": 1}, ["_id", "s"]), ({"s": True, "_id": 0}, ["s"]), ({"s": 0, "n": False}, ["_id", "b", "l", "m"]), ({"s": 1, "n": 0, "no": 1}, ["_id", "s"]), ({}, ["_id", "s", "n", "b", "l", "m"]), ({"s": 2.0, "_id": 1}, ["s", "_id"]),
])
def test_projection(docs, spec, columns):
    assert doc.project(docs, spec).columns == columns


def test_sort_skip_limit(docs):
    ids = [r._id for r in doc.find(docs, None, [("b", -1), ("n", 1)], 2, 3).collect()]
    key = lambda r: (r.b is None, not r.b if r.b is not None else 0, r.n is not None, r.n or 0, r._id)
    assert ids == [r._id for r in sorted(docs.collect(), key=key)][2:5]
    assert [r._id for r in doc.find(docs, skip=7).collect()] == [8, 9]
    page, total = doc.find_with_total(docs, {"b": True}, limit=2)
    assert [r._id for r in page.collect()] == [1, 4] and total.first().total == 4
    assert doc.find_one(docs, {"n": {"$gt": 5}}).first()._id == 1
    assert doc.aggregate(docs, [{"$match": {"b": True}}, {"$sort": {"n": -1}}, {"$skip": 1}, {"$limit": 2}]).select("_id").collect() == [(6,), (1,)]
    assert doc.aggregate(docs, [{"$limit": 0}]).count() == 0 and doc.aggregate(docs, [{"$skip": 99}]).count() == 0


def test_count_and_distinct(docs):
    assert doc.count(docs, {"s": {"$in": ["10", "9"]}}).first().n == 2
    assert {r.b for r in doc.distinct(docs, "b").collect()} == {True, False}
    assert doc.distinct(docs, "nothing").count() == 0


def by_id(df):
    return {r._id: r for r in df.collect()}


def test_update_operators(docs):
    update = {"$set": {"s": "new", "extra": 5}, "$unset": {"b": 1}, "$inc": {"n": 2, "s": 1, "count": 3}, "$push": {"l": "z", "s": "q"}}
    old, new = by_id(docs), by_id(doc.update_many(docs, {"n": {"$gt": 5}}, update))
    for i, r in new.items():
        if old[i].n is not None and old[i].n > 5:
            assert (r.s, r.extra, r.b, r["count"], r.l) == ("new", 5, None, 3, [*(old[i].l or []), "z"]) and math.isclose(r.n, old[i].n + 2)
        else:
            assert (r.s, r.n, r.b, r.l, r.extra, r["count"]) == (old[i].s, old[i].n, old[i].b, old[i].l, None, None)
    sets = by_id(doc.update_many(docs, None, {"$addToSet": {"l": "a"}}))
    assert sets[1].l == ["a", "b"] and sets[7].l == ["c", "a"] and sets[3].l == ["a"]
    assert by_id(doc.update_many(docs, None, {"$pull": {"l": "a"}}))[5].l == ["b"]
    with pytest.raises(ValueError):
        doc.update_many(docs, None, {"$rename": {"a": "b"}})


def test_single_document_mutations(docs):
    assert {i for i, r in by_id(doc.update_one(docs, {"b": True}, {"$set": {"s": "hit"}})).items() if r.s == "hit"} == {1}
    up = doc.update_one(docs, {"s": "none"}, {"$inc": {"n": 4}}, upsert=True, new_id=77)
    assert (by_id(up)[77].s, by_id(up)[77].n) == ("none", 4.0) and up.count() == 10
    assert doc.update_one(docs, {"s": "10"}, {"$inc": {"n": 4}}, upsert=True, new_id=77).count() == 9
    r = by_id(doc.replace_one(docs, {"b": True}, {"s": "only"}))[1]
    assert (r.s, r.n, r.b, r.l, r.m) == ("only", None, None, None, None)
    assert by_id(doc.replace_one(docs, {"s": "none"}, {"s": "fresh"}, upsert=True, new_id=78))[78].s == "fresh"
    assert set(by_id(doc.delete_one(docs, {"b": True}))) == set(range(2, 10))
    assert set(by_id(doc.delete_many(docs, {"b": True}))) == {2, 3, 5, 7, 9}
    assert doc.delete_one(docs, {"b": True, "n": -1}).count() == 9


def test_versions(docs):
    v = docs.withColumn("_version", F.lit(1)).withColumn("_createdAt", F.lit("then")).withColumn("_updatedAt", F.lit("then"))
    r = by_id(doc.update_many(v, {"b": True}, {"$set": {"s": "x"}}, F.lit("now")))
    assert (r[1]._version, r[1]._updatedAt, r[2]._version, r[2]._updatedAt) == (2, "now", 1, "then")
    r = by_id(doc.replace_one(doc.update_many(v, None, {}), {"b": True}, {"s": "x"}))[1]
    assert (r._version, r._createdAt) == (1, "then")


def test_inserts(spark, docs):
    new = spark.createDataFrame([(1, "dup"), (50, "a"), (50, "b"), (51, "c")], "_id long, s string")
    out = by_id(doc.insert_many(docs, new))
    assert len(out) == 11 and out[1].s == "10" and out[50].s == "a"
    with pytest.raises(ValueError):
        doc.insert_many(docs, new, ordered=True)
    with pytest.raises(ValueError):
        doc.insert_one(docs, {"_id": 1})
    assert by_id(doc.insert_one(docs, {"_id": 60, "s": "one"}))[60].s == "one"
    text = spark.createDataFrame([("k", 1)], "_id string, n long")
    assert all(r._id for r in doc.insert_many(text, spark.createDataFrame([(None, 2), (None, 3)], "_id string, n long")).collect())


def test_bulk_write(docs):
    ops = [{"insert_one": {"document": {"_id": 1}}}, {"delete_many": {"spec": {"b": True}}}, {"update_one": {"spec": {"_id": 2}, "update": {"$set": {"s": "bulk"}}}}, {"strange": {}}]
    out, errors = doc.bulk_write(docs, ops, ordered=False)
    assert len(errors) == 2 and by_id(out)[2].s == "bulk" and out.count() == 5
    with pytest.raises(ValueError):
        doc.bulk_write(docs, ops)


def test_information(docs):
    info = doc.collection_info(docs).first()
    assert info.documents == 9 and info.bytes > 100
    assert {(r.b, r.n) for r in doc.duplicate_keys(docs, ["b"], sparse=True).collect()} == {(True, 4), (False, 3)}


def test_numbers_print_without_fraction(spark):
    from sparkloom.functions.values import text_of

    values = [100.0, 1.5, -2.25, 1e21, 1e-7, 123456789.0, 0.0, 2.5e25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(text_of(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == ["100", "1.5", "-2.25", "1e+21", "1e-07", "123456789", "0", "2.5e+25"]
    r = random.Random(1)
    assert all(re.match(NUMBER, str(r.uniform(-9, 9))) for _ in range(50))
