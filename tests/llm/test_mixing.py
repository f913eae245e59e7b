import re

import numpy as np
import pytest

from larkspur.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def waterfill(sizes, weights, total, most):
    """The level at which min(most * size, level * weight) sums to the total, by bisection."""
    lo, hi = 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(most * s, hi * w) for s, w in zip(sizes, weights)]


def test_targets():
    rng = np.random.RandomState(0)
    for _ in range(50):
        sizes = rng.randint(0, 1000, 7).tolist()
        weights = [(3, 1, 2)[i % 3] for i in range(7)]
        got = mixing.targets(sizes, weights, 1.5 * sum(sizes))
        assert np.allclose(got, waterfill(sizes, weights, 1.5 * sum(sizes), 2), rtol=1e-6, atol=1e-6)
    assert mixing.targets([], [], 0) == []


def test_split_tree_is_exact():
    counts = np.array([0, 5, 1024, 17])
    dealt = mixing.split_tree(counts, 7, 1)
    assert (dealt.sum(0) == counts).all() and dealt.min() >= 0
    assert np.ptp(dealt.sum(1)) <= 4
    assert (dealt == mixing.split_tree(counts, 7, 1)).all()


def test_query_against_brute_force(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: r for r in __spark_entry__.queries()["op6_mixing"](spark, d).collect()}
    size = {r.doc_id: words(r.text) for r in docs}
    names = sorted({r.source for r in docs}, key=lambda s: s.encode())
    by = {s: [r.doc_id for r in docs if r.source == s] for s in names}
    sizes = [sum(size[i] for i in by[s]) for s in names]
    want = waterfill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    assert len(got) == len(docs)
    for s, n, t in zip(names, sizes, want):
        for i in by[s]:
            r = got[i]
            assert r["size"] == size[i] and r.source_size == n and r.target == pytest.approx(t, rel=1e-6)
            assert r.taken in (0, size[i], 2 * size[i])
        assert abs(sum(got[i].taken for i in by[s]) - t) <= max(size[i] for i in by[s])
    again = {r.doc_id: r for r in __spark_entry__.queries()["op6_mixing"](spark, d).collect()}
    assert again == got


def test_edges(spark):
    schema = "doc_id long, text string, source string, mix_size string"
    assert mixing.mix(spark.createDataFrame([], schema).drop("mix_size")).collect() == []
    rows = [(1, "a b c", None), (None, None, "x"), (2, "", "x"), (3, "a " * 400, "x"), (3, "a " * 400, "x"), (4, "q\x0bz y", "é")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = [(r.doc_id, r.source, r.mix_size, r.mix_copies, len(r.mix_shards)) for r in out.collect()]
    assert len(got) == 6 and all(c == n <= 2 for *_, c, n in got)
    assert {(i, s, n) for i, s, n, *_ in got} == {(1, None, 3), (None, "x", 0), (2, "x", 0), (3, "x", 400), (4, "é", 2)}


def test_draw_repeats_and_shards(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 13), "ab"[i % 2]) for i in range(500)], "doc_id long, text string, source string")
    rows = mixing.draw(docs, shards=8).collect()
    mixed = {r.doc_id: r.mix_copies for r in mixing.mix(docs, shards=8).collect()}
    assert len(rows) == sum(mixed.values())
    assert {r.mix_shard for r in rows} == set(range(8))


def test_many_sources_are_cut_as_one_by_one(spark):
    docs = [(i, f"s{i % 37}", 1 + i * 7 % 23) for i in range(20_000)] + [(20_000, "one", 5), (20_001, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, mix_size long")
    got = mixing.mix(df).collect()
    by = {s: [r for r in got if r.source == s] for s in {s for _, s, _ in docs}}
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    sizes = [sum(r.mix_size for r in by[s]) for s in names]
    want = waterfill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    for s, t in zip(names, want):
        assert abs(sum(r.mix_copies * r.mix_size for r in by[s]) - t) <= max(r.mix_size for r in by[s])
        assert all(0 <= r.mix_copies <= 2 for r in by[s])
