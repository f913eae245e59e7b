import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import store, text
from larkspur.llm.chunks import with_chunks


def words(t):
    return (t or "").encode().split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab \t\n\x0b\x0c\r\x1cé日 "), max_size=25)), max_size=8))
def test_words_are_those_of_each_text(texts):
    data, bounds = text.buffers(pa.array(texts, pa.string()))
    seen = []
    for lo, hi, part, edges in text.slices(data, bounds, 16):
        w = text.Words(part, edges)
        flat = [part[s:e].tobytes() for s, e in zip(w.starts, w.ends)]
        for k in range(hi - lo):
            assert flat[w.firsts[k] : w.firsts[k + 1]] == words(texts[lo + k])
        assert w.counts.tolist() == [len(words(t)) for t in texts[lo:hi]]
        seen += list(zip(flat, w.hashes().tolist()))
    by = {}
    for word, h in seen:
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_sliced_and_chunked_arrays():
    a = pa.chunked_array([["x y", None], ["z"]])
    data, bounds = text.buffers(a)
    assert data.tobytes() == b"x yz" and bounds.tolist() == [0, 3, 3, 4]
    data, bounds = text.buffers(pa.array(["no", "é b", "c"]).slice(1, 1))
    assert data.tobytes() == "é b".encode() and bounds.tolist() == [0, 4]
    assert text.buffers(pa.array([], pa.string()))[1].tolist() == [0]


def test_runs_hash_by_their_order():
    x = np.random.RandomState(0).randint(0, 3, 3000).astype(np.uint64)
    starts = np.arange(2900)
    h = text.run_hashes(x, starts, starts + 9, 0x9E3779B97F4A7C15)
    by = {}
    for s, v in zip(starts.tolist(), h.tolist()):
        assert by.setdefault(tuple(x[s : s + 9]), v) == v
    assert len(set(by.values())) == len(by)


def test_sql_words(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1cé") for _ in range(rng.randint(0, 20))) for _ in range(300)] + [None, "", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.sql_words(F.col("t")).alias("w")).collect()
    assert all([w.encode() for w in r.w] == words(r.t) for r in rows)


def test_chunks_follow_the_row_alone(spark):
    df = spark.createDataFrame([(i, "w " * 50) for i in range(400)] + [(None, None)], "doc_id long, text string")
    a = with_chunks(df, 2000)
    b = with_chunks(df.repartition(7), 2000)
    key = lambda rows: sorted((r.doc_id or -1, r.chunk) for r in rows)
    assert key(a.collect()) == key(b.collect())
    sizes = [r["count"] for r in a.groupBy("chunk").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 50


def test_saved_tables_cut_lineage(spark):
    df = store.saved(spark.range(5).withColumn("x", F.rand()), "t")
    assert df.collect() == df.collect() and "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
