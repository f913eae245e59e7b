import random

from larkspur.llm.graph import components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent if root(x) != x}


def check(spark, edges, kind="long"):
    got = components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()
    assert {r.id: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_components(spark):
    rng = random.Random(3)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(220)])
    path = [(i, i + 1) for i in range(120)]
    rng.shuffle(path)
    check(spark, path)
    check(spark, [(7, i) for i in range(200)] + [(3, 7), (500, 3), (9, 9)])
    check(spark, [])
    check(spark, [(b"b", b"a"), (b"c", b"b"), (b"x", b"y")], "binary")
