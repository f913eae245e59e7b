import hashlib
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import fingerprints as P


def numbered(text, k):
    words = (text or "").split()
    grams = [tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)] if words else []
    seen, out = {}, []
    for g in grams:
        seen[g] = seen.get(g, -1) + 1
        out.append((g, seen[g]))
    return out


def test_occurrences_are_numbered(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randint(0, 70))) for i in range(150)] + ["", None, "x", "a " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r.i: r.v for r in df.select("i", P.numbered_kmers(F.col("t"), 2).alias("v")).collect()}
    back = {}
    for i, t in enumerate(texts):
        want = numbered(t, 2)
        got = sorted((v & P._LOW, v >> 31) for v in rows[i])
        assert [at for at, _ in got] == list(range(len(want)))
        for (_, h), name in zip(got, want):
            assert back.setdefault(h, name) == name  # one hash, one numbered k-mer
    assert len(back) == len({x for t in texts for x in numbered(t, 2)})


def spark_hash(*values):
    """The built-in hash: each value's with the hash so far as its seed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, Long) else "<i", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return Long(seed - (1 << 64) if seed >> 63 else seed)


class Long(int):
    pass


def brute_slots(text, k=2):
    high = lambda x: Long((x >> 31) << 31)
    kmers = [high(spark_hash(high(spark_hash(*gram)), n)) for gram, n in numbered(text, k)]
    out = []
    for j in range(P.SLOTS):
        order = sorted(range(len(kmers)), key=lambda at: (high(spark_hash(kmers[at], j)), at))
        chosen = [high(spark_hash(kmers[at], j)) for at in sorted(order[:2])]
        if chosen:
            digest = spark_hash(*chosen)
            out.append(f"{(digest >> 32) & 0xFFFFFFFF:08x}")
    return "".join(out)


def test_fingerprints_against_brute_force(spark):
    """The two least k-mers of one order, in text order; a hash of nothing leaves the hash so far."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "x", "x y", "x y z", "a a a a", "é ü " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.f or "" for r in P.signatures(df, ["i"]).select("i", P.as_text(F.col("slots")).alias("f")).collect()}
    assert got == {i: brute_slots(t) for i, t in enumerate(texts)}


def brute_edit(docs):
    """docs: distinct (id, text), descending. id: edited text and the next's id."""
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(order):
        j, n = order[(k + 1) % len(order)]
        t, n = t or "", n or ""
        half = len(t) // 2
        out[i] = t[: len(t) - half] + n[:half], j
    return out


def check(got, docs):
    want, by = brute_edit(docs), {r.doc_id: r for r in got}
    texts = {i: t or "" for i, t in docs}
    assert len(got) == len(docs)
    alike = lambda a, b: np.mean([a[k : k + 8] == b[k : k + 8] for k in range(0, 8 * P.SLOTS, 8)])
    for i, (edited, j) in want.items():
        r = by[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == (8 * P.SLOTS if texts[i].split() else 0)
        if r.fingerprint and r.edited_fingerprint:
            assert r.near_edited == pytest.approx(alike(r.fingerprint, r.edited_fingerprint), abs=1e-9)
        if r.fingerprint and by[j].fingerprint:
            assert r.near_next == pytest.approx(alike(r.fingerprint, by[j].fingerprint), abs=1e-9)
        if edited == texts[i]:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, by[i].fingerprint) == by[i].fingerprint


def test_query_against_brute_force(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = __spark_entry__.queries()["op1_fingerprints"](spark, d).collect()
    check(got, docs)
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.06 > 5 * np.mean([r.near_next for r in long])


def test_order_matters(spark):
    """Moving a part keeps the content; the fingerprint changes all the same."""
    words = [f"w{i}" for i in range(300)]
    swapped, edited = words[150:] + words[:150], words[:100] + ["x"] + words[101:]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(swapped)), (2, " ".join(edited))], "id long, text string")
    s = {r.id: np.array(r.slots) for r in P.signatures(df, ["id"]).collect()}
    moved, replaced = (s[0] == s[1]).mean(), (s[0] == s[2]).mean()
    assert 0.3 < moved < 0.75 and replaced > 0.9


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b", 1), (5, None, 1), (5, None, 1), (7, "é\x0bü x" * 30, 1), (8, "é\x0bü x" * 30, 1), (9, "q", 1), (-3, "long " * 20_000, 1)], "doc_id long, text string, th int")
    got = P.fingerprint_edits(df).collect()
    assert [r.doc_id for r in got].count(5) == 2 and len(got) == 7 and len(set(got)) == 6  # every row, repeated ones alike
    check(list(set(got)), [(None, "a b"), (5, None), (7, "é\x0bü x" * 30), (8, "é\x0bü x" * 30), (9, "q"), (-3, "long " * 20_000)])
    assert P.fingerprint_edits(df.limit(0)).collect() == []
    one = P.fingerprint_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1


def test_no_python_runs_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a b c")], "id long, text string")
    plan = P.signatures(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def written(spark, run):
    """Bytes that the stages of run() write to shuffles."""
    sc = spark._jsc.sc()
    none = spark._jvm.java.util.ArrayList()

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = total()
    run()
    return sum(n for stage, n in total().items() if stage not in before)


@pytest.fixture
def no_broadcasts(spark):
    """Small tables are joined as large ones are."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, had)


@pytest.mark.parametrize("repeated", [0, 1], ids=["distinct rows", "a repeated row"])
def test_texts_are_shuffled_once_and_tails_once(spark, tmp_path, repeated, no_broadcasts):
    """Of equal lengths, a tail is half a text: 1.5 times the texts, narrow rows besides."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"{rng.getrandbits(64):016x}" for _ in range(1200))) for i in range(150)]
    spark.createDataFrame(rows + rows[:repeated], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    once = written(spark, lambda: docs.repartition(4, "doc_id").write.parquet(f"{tmp_path}/once"))
    got = written(spark, lambda: P.fingerprint_edits(docs).write.parquet(f"{tmp_path}/out"))
    assert once > 2_000_000
    assert got < 1.75 * once
