"""Small documents with known results: accumulators, pipelines, commands, writes, transactions."""

import datetime as dt

import pytest

from larkspur.functions import values as V
from larkspur.operators.collection import Collection, DuplicateKey
from larkspur.operators.database import Database
from larkspur.plans import pipeline as P
from larkspur.sources import tables
from larkspur.streaming import stream_pipeline


@pytest.fixture
def db(spark):
    return Database(spark)


def filled(db, name, docs):
    c = db.collection(name)
    c.insert(docs)
    return c


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_avg(db):
    c = filled(db, "scores", [{"subject": s, "score": n} for s, n in (("math", 80), ("math", 90), ("english", 70), ("english", 80))])
    assert rows(c.aggregate([{"$group": {"_id": "$subject", "avg": {"$avg": "$score"}}}, {"$sort": {"_id": 1}}])) == [{"_id": "english", "avg": 75.0}, {"_id": "math", "avg": 85.0}]


def test_min_max(db):
    c = filled(db, "temps", [{"city": x, "temp": t} for x, t in (("Tokyo", 25), ("Tokyo", 30), ("Tokyo", 20), ("London", 15), ("London", 18))])
    got = rows(c.aggregate([{"$group": {"_id": "$city", "low": {"$min": "$temp"}, "high": {"$max": "$temp"}}}, {"$sort": {"_id": 1}}]))
    assert got == [{"_id": "London", "low": 15, "high": 18}, {"_id": "Tokyo", "low": 20, "high": 30}]


def test_push_and_add_to_set(db):
    c = filled(db, "orders", [{"customer": a, "item": b} for a, b in (("Alice", "banana"), ("Alice", "apple"), ("Bob", "cherry"), ("Alice", "banana"), ("Alice", None))])
    got = rows(c.aggregate([{"$group": {"_id": "$customer", "all": {"$push": "$item"}, "set": {"$addToSet": "$item"}}}, {"$sort": {"_id": 1}}]))
    assert got == [{"_id": "Alice", "all": ["banana", "apple", "banana", None], "set": ["banana", "apple", None]}, {"_id": "Bob", "all": ["cherry"], "set": ["cherry"]}]


def test_sum_and_count(db):
    c = filled(db, "t", [{"_id": 1, "cat": "a", "x": 10}, {"_id": 2, "cat": "a", "x": 20}, {"_id": 3, "cat": "b", "x": 7}])
    got = rows(c.aggregate([{"$group": {"_id": "$cat", "sum": {"$sum": "$x"}, "n": {"$count": {}}}}, {"$sort": {"_id": 1}}]))
    assert got == [{"_id": "a", "sum": 30.0, "n": 2}, {"_id": "b", "sum": 7.0, "n": 1}]


def test_stages_together(db):
    filled(db, "foreign", [{"_id": 10, "k": 1, "v": "hit"}, {"_id": 11, "k": 2, "v": "miss"}])
    c = filled(db, "local", [{"_id": 1, "k": 1, "arr": [1, 2], "x": 5}])
    stages = [{"$unwind": "$arr"}, {"$addFields": {"y": "$x"}}, {"$unset": "x"}, {"$lookup": {"from": "foreign", "localField": "k", "foreignField": "k", "as": "m"}}, {"$replaceRoot": {"newRoot": {"a": "$arr", "y": "$y", "m": "$m"}}}, {"$sort": {"a": 1}}]
    assert rows(c.aggregate(stages)) == [{"a": a, "y": 5, "m": [{"_id": 10, "k": 1, "v": "hit"}]} for a in (1, 2)]


def test_aggregate_and_distinct_commands(db):
    filled(db, "foo", [{"x": 1, "y": 2}, {"x": 1, "y": 1}, {"x": 2, "y": 0}])
    got = db.run_command({"aggregate": "foo", "pipeline": [{"$match": {"x": 1}}, {"$sort": {"y": 1}}, {"$limit": 1}, {"$project": {"y": 1, "_id": 0}}]})
    assert got["ok"] == 1 and got["cursor"] == {"id": 0, "ns": "foo", "firstBatch": [{"y": 1}]}
    assert db.run_command({"aggregate": "foo", "pipeline": [{"$match": {"x": 1}}, {"$count": "n"}]})["cursor"]["firstBatch"] == [{"n": 2}]
    assert sorted(db.run_command({"distinct": "foo", "key": "x"})["values"]) == [1, 2]
    assert db.run_command({"count": "foo", "query": {"x": 1}})["n"] == 2
    assert db.run_command({"aggregate": "none", "pipeline": []})["cursor"]["firstBatch"] == []
    assert db.run_command({"aggregate": "foo", "pipeline": [{"$bucket": {}}]})["codeName"] == "BadValue"
    assert db.run_command({"aggregate": "foo", "pipeline": [{"$match": {}, "$limit": 1}]})["ok"] == 0
    assert db.run_command({"nothing": 1})["codeName"] == "CommandNotFound"


def test_find_and_modify(db):
    filled(db, "foo", [{"x": 1, "y": 2}, {"x": 1, "y": 1}])
    got = db.run_command({"findAndModify": "foo", "query": {"x": 1}, "sort": {"y": 1}, "update": {"$set": {"z": 9}}, "new": True})["value"]
    assert (got["y"], got["z"]) == (1, 9)
    old = db.run_command({"findAndModify": "foo", "query": {"y": 1}, "remove": True})["value"]
    assert old["z"] == 9 and db.collection("foo").count() == 1
    assert db.run_command({"findAndModify": "foo", "query": {"y": 1}, "remove": True})["value"] is None
    assert db.run_command({"findAndModify": "foo", "query": {"y": 5}, "update": {"$set": {"z": 1}}, "upsert": True, "new": True})["value"]["y"] == 5


def test_cursors(db):
    filled(db, "foo", [{"x": i} for i in range(200)])
    first = db.run_command({"find": "foo", "batchSize": 50, "sort": {"x": 1}})["cursor"]
    assert len(first["firstBatch"]) == 50 and first["id"]
    more = db.run_command({"getMore": first["id"], "collection": "foo", "batchSize": 50})["cursor"]
    assert [d["x"] for d in more["nextBatch"]] == list(range(50, 100))
    assert db.run_command({"killCursors": "foo", "cursors": [first["id"], 999]})["cursorsNotFound"] == [999]
    assert db.run_command({"getMore": first["id"]})["code"] == 43
    assert db.run_command({"find": "nowhere"})["cursor"] == {"id": 0, "ns": "nowhere", "firstBatch": []}


def test_explain_does_not_run(db):
    filled(db, "foo", [{"x": 1}])
    plan = db.run_command({"explain": {"find": "foo", "filter": {"x": 1}}})
    assert "Filter" in plan["queryPlanner"]["winningPlan"]["plan"]
    assert db.run_command({"explain": {"find": "none"}})["queryPlanner"]["winningPlan"]["stage"] == "EOF"


def test_inserts_and_indexes(db):
    c = filled(db, "c", [{"_id": 1, "a": 5}])
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": 1, "a": 6}])
    assert db.run_command({"insert": "c", "documents": [{"_id": 1}]})["writeErrors"][0]["code"] == 11000
    assert c.count() == 1
    assert isinstance(c.insert_one({"b": 1}) if False else V.ObjectId(), str)
    assert c.create_index({"a": 1}, unique=True) == "a_1"
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": 2, "a": 5}])
    assert [i.name for i in c.list_indexes()] == ["_id_", "a_1"]
    with pytest.raises(ValueError):
        c.drop_index("_id_")
    assert db.run_command({"dropIndexes": "c", "index": "*"})["ok"] == 1
    c.insert([{"_id": 2, "a": 5}])
    assert db.run_command({"validate": "c"})["valid"] and db.validate()["valid"]
    assert db.run_command({"createIndexes": "c", "indexes": [{"key": {"a": 1}, "unique": True, "name": "u"}]})["codeName"] == "DuplicateKey"
    assert db.run_command({"listIndexes": "zz"})["code"] == 26
    for bad in ({"": 1}, {"$a": 1}, {"_id": None}, {"_id": [1]}, {"a": {"b\0": 1}}):
        with pytest.raises(ValueError):
            c.insert([bad])
    with pytest.raises(ValueError):
        db.register("system.x", None)


def test_updates(db):
    c = filled(db, "u", [{"_id": i, "x": x, "t": t} for i, x, t in ((1, 1, [1, 2]), (2, 1, [2]), (3, None, None))])
    r = c.update_many({"x": 1}, {"$inc": {"x": 4}, "$push": {"t": 9}})
    assert (r.matched_count, r.modified_count) == (2, 2)
    assert [(d["x"], d["t"]) for d in rows(c.find(sort={"_id": 1}))] == [(5, [1, 2, 9]), (5, [2, 9]), (None, None)]
    assert c.update_many({"x": 5}, {"$set": {"x": 5}}).modified_count == 0
    c.update_one({"_id": 1}, {"$pull": {"t": 2}, "$rename": {"x": "z"}})
    one = c.find_by_id(1)
    assert (one["x"], one["z"], one["t"]) == (None, 5, [1, 9])
    c.update_many({"_id": 3}, {"$inc": {"x": 2**40}})
    assert c.find_by_id(3)["x"] is None or isinstance(c.find_by_id(3)["x"], int)
    with pytest.raises(Exception, match="array"):
        c.update_many({"_id": 3}, {"$push": {"t": 1}})
    r = c.update_many({"_id": 77}, {"$set": {"x": 3}, "$setOnInsert": {"z": 4}}, upsert=True)
    assert r.upserted_id == 77 and c.find_by_id(77)["z"] == 4
    c.update_one({"_id": 2}, {"$currentDate": {"at": True}, "$min": {"x": 1}, "$mul": {"q": 3}})
    two = c.find_by_id(2)
    assert two["x"] == 1 and two["q"] == 0.0 and isinstance(two["at"], dt.datetime)
    assert c.delete_many({"_id": {"$in": [1, 2]}}) == 2 and c.delete_one({"_id": 9}) == 0
    assert c.replace_one({"_id": 77}, {"x": 8}) == 1
    assert {k: v for k, v in c.find_by_id(77).items() if v is not None} == {"_id": 77, "x": 8}


def test_transactions(db):
    about = lambda n: {"lsid": {"id": b"1"}, "txnNumber": n, "autocommit": False}
    for n, end, left in ((1, "abortTransaction", 0), (2, "commitTransaction", 1)):
        assert db.run_command({"insert": "x", "documents": [{"_id": n, "x": n}], **about(n)})["n"] == 1
        assert db.run_command({"count": "x"})["n"] == 0
        assert db.run_command({end: 1, **about(n)})["ok"] == 1
        assert db.run_command({end: 1, **about(n)})["ok"] == 1
        assert db.run_command({"count": "x"})["n"] == left
    assert db.run_command({"insert": "x", "documents": [{"x": 1}], **about(1)})["ok"] == 0
    assert db.run_command({"abortTransaction": 1, **about(2)})["ok"] == 0
    assert db.run_command({"refreshSessions": [{"id": b"1"}]})["ok"] == db.run_command({"endSessions": [{"id": b"1"}]})["ok"] == 1
    for name in ("ping", "hello", "isMaster", "buildInfo", "listCollections", "dbStats", "serverStatus", "connectionStatus"):
        assert db.run_command({name: 1})["ok"] == 1
    assert db.run_command({"collStats": "x"})["count"] == 1 and db.run_command({"drop": "x"})["ok"] == 1 and db.list_collections() == []


def test_order_is_the_sorts(db):
    c = filled(db, "o", [{"_id": i, "s": s, "n": n} for i, (s, n) in enumerate([("b", 1), ("a", 2), (None, 3), ("b", 0), ("a", None)])])
    assert [d["_id"] for d in rows(c.find(sort={"s": -1, "n": 1}))] == [3, 0, 4, 1, 2]
    got = rows(c.aggregate([{"$sort": {"s": -1, "n": 1}}, {"$group": {"_id": None, "all": {"$push": "$_id"}, "first": {"$first": "$n"}, "last": {"$last": "$n"}}}]))
    assert got == [{"_id": None, "all": [3, 0, 4, 1, 2], "first": 0, "last": 3}]
    assert [d["_id"] for d in rows(c.aggregate([{"$skip": 1}, {"$limit": 2}]))] == [1, 2]
    got = rows(c.aggregate([{"$sort": {"n": -1}}, {"$group": {"_id": "$s", "n": {"$push": "$n"}}}, {"$limit": 2}]))
    assert [(d["_id"], d["n"]) for d in got] == [(None, [3]), ("a", [2, None])]


def test_sorts_that_nothing_needs_are_left_out(db):
    c = filled(db, "o", [{"a": 1}])
    frame = P.run(c.source(), [{"$sort": {"a": 1}}, {"$group": {"_id": "$a", "n": {"$sum": 1}}}])
    assert "Sort" not in frame.df._jdf.queryExecution().optimizedPlan().toString() and frame.notes


def test_lookups_become_joins(db):
    filled(db, "r", [{"_id": 1, "k": 1}])
    c = filled(db, "l", [{"_id": 1, "k": 1}, {"_id": 2, "k": 2}])
    look = {"$lookup": {"from": "r", "localField": "k", "foreignField": "k", "as": "m"}}
    plan = lambda *s: P.run(c.source(), [look, *s], c._find).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan({"$unwind": "$m"}) and "collect_list" not in plan({"$unwind": "$m"})
    assert "Join LeftAnti" in plan({"$match": {"m": {"$size": 0}}})
    assert "Join LeftSemi" in plan({"$match": {"m": {"$ne": []}}}, {"$unset": "m"})
    assert "collect_list" in plan({"$match": {"m": {"$ne": []}}})
    assert rows(c.aggregate([look, {"$match": {"m": {"$size": 0}}}])) == [{"_id": 2, "k": 2, "m": []}]


def test_projection_rules(db):
    c = filled(db, "p", [{"_id": 1, "a": {"b": {"c": 1, "d": 2}, "e": 3}, "f": 4}])
    assert rows(c.find({}, {"a.b.c": 1, "a.e": 1})) == [{"_id": 1, "a": {"b": {"c": 1}, "e": 3}}]
    assert rows(c.find({}, {"f": 1, "_id": 0})) == [{"f": 4}]
    assert rows(c.find({}, {"a": 0, "f.x": 0})) == [{"_id": 1, "f": 4}]
    assert rows(c.find({}, {"f": True, "a": "$f"})) == [{"_id": 1}]
    assert rows(c.find({}, {"_id": 0, "f": 0})) == [{"a": {"b": {"c": 1, "d": 2}, "e": 3}}]


def test_values():
    order = [V.MinKey, None, 1, "a", {"a": 1}, [1], b"x", V.ObjectId("0" * 24), True, dt.datetime(2020, 1, 1), V.Timestamp(1, 1), V.Regex("a"), V.MaxKey]
    assert sorted(order[::-1], key=V.sort_key) == order
    assert V.compare(2**53, 2**53 + 1) < 0 < V.compare(2**62, float(2**53)) and V.compare(10, 10.0) == 0
    assert V.compare(float("nan"), 1e308) > 0 and V.compare({"a": 1, "b": 1}, {"z": 9}) > 0 and V.compare([1], [1, 0]) < 0
    got = V.literal({"a": {"$date": "2020-01-01T00:00:00Z"}, "b": [{"$numberLong": "5"}, {"$oid": "A" * 24}], "c": {"$numberDecimal": "1.10"}, "d": {"$date": 0}})
    assert got == {"a": dt.datetime(2020, 1, 1), "b": [5, "a" * 24], "c": V.decimal.Decimal("1.10"), "d": dt.datetime(1970, 1, 1)}
    with pytest.raises(ValueError):
        V.literal({"$numberDecimal": "1E500"})


def test_snapshots(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    c = filled(db, "s", [{"_id": 1, "a": 1}])
    c.insert([{"_id": 2, "a": 2}])
    assert Database(spark, str(tmp_path)).open_snapshot("s").count() == 2
    (tmp_path / "x.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert tables.read_json(spark, str(tmp_path / "x.json"), c.df.select("a").schema).count() == 2
    assert tables.read_documents(spark, str(tmp_path / "x.json")).count() == 2


def test_stream(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 AS k", "array(id, id + 1) AS l").write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("id long, k long, l array<long>").parquet(str(tmp_path / "in"))
    out = stream_pipeline(df, [{"$match": {"k": {"$gt": 0}}}, {"$unwind": "$l"}, {"$project": {"_id": 0, "id": 1, "l": 1}}])
    query = out.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("streamed").count() == 26
    with pytest.raises(ValueError):
        stream_pipeline(df, [{"$sort": {"k": 1}}])


def test_empty_collections(spark):
    c = Collection(spark, "e")
    assert c.find({"a": 1}).collect() == [] and c.count() == 0 and c.find_one() is None and c.delete_many({}) == 0
    assert rows(c.aggregate([{"$group": {"_id": "$a", "n": {"$sum": 1}}}])) == [] and rows(c.aggregate([{"$count": "n"}])) == [{"n": 0}]
