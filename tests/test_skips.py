"""$skip: with a $limit after it a top-k."""

import random

import __spark_entry__
import pytest
from larkspur.operators.collection import Collection

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sort_skip_limit", "limit_from_the_end", "skip_limit_in_scan_order"])
def test_skip_and_limit_are_a_top_k(spark, name):
    text = plan(__spark_entry__.queries()[name](spark, DATA))
    assert "TakeOrderedAndProject" in text and "GlobalLimit" not in text and "SinglePartition" not in text


def test_skips_beside_python(spark):
    rng = random.Random(4)
    some = lambda *x: rng.choice([None, *x])
    docs = [(i // 3, some("a", "b", "c"), some(0.0, 1.5, float("inf"))) for i in range(60)]
    c = Collection(spark, "x", spark.createDataFrame(docs, "k long, s string, v double").repartition(5), ["k"])
    up, down = (lambda x: (x is not None, x or 0)), (lambda x: (x is None, -(x or 0)))
    order = sorted(docs, key=lambda d: (up(d[2]), [-ord(x) for x in d[1] or "\0"], d[0]))
    turned = sorted(docs, key=lambda d: (down(d[2]), d[1] is not None, d[1] or "", d[0]))
    for n in (0, 1, 2, 17, 29, 58, 59, 60, 200):
        for sort, want in (({"v": 1, "s": -1}, order), ({"v": -1, "s": 1}, turned)):
            assert [tuple(r) for r in c.aggregate([{"$sort": sort}, {"$skip": n}]).collect()] == want[n:]
            assert [tuple(r) for r in c.aggregate([{"$sort": sort}, {"$skip": n - n // 3}, {"$skip": n // 3}, {"$limit": 0}, {"$limit": 7}]).collect()] == want[n : n + 7]
            assert [tuple(r) for r in c.aggregate([{"$sort": sort}, {"$limit": 30}, {"$skip": n}]).collect()] == want[n:30]
        left = c.aggregate([{"$skip": n}]).collect()
        assert len(left) == max(0, 60 - n) and sorted(r.k for r in left) == [i // 3 for i in range(60)][n:]
