import zlib

import numpy as np
import pytest

from larkspur.llm import toxicity
from larkspur.llm.text import buffers


def test_features_are_words_pairs_and_skips():
    import pyarrow as pa

    text, feature = toxicity.distinct(*toxicity.features(*buffers(pa.array(["One two, THREE", None, "one", "one two", ""]))))
    count = np.bincount(text, minlength=5).tolist()
    assert count == [6, 0, 1, 3, 0]
    assert set(feature[text == 3]) <= set(feature[text == 0])


def test_held_out_quality(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in __spark_entry__.queries()["op3_toxicity"](spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    rows = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r.doc_id].held_out]
    hit = sum(r.predicted and y for r, y in rows)
    assert hit >= 0.6 * sum(y for _, y in rows) and hit >= 0.95 * sum(r.predicted for r, _ in rows)


def test_labels_that_are_held_out_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "vile thing" if i % 2 else "fine thing") for i in range(300)], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = [(i, i % 2) for i in range(300)]
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (sorted(toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert a == b
    assert np.mean([r.score for r in a if r.doc_id % 2]) > np.mean([r.score for r in a if r.doc_id % 2 == 0]) + 0.5


def test_edges(spark):
    docs = spark.createDataFrame([(None, "x", 1), (2, None, 1), (3, "", 1), (3, "", 1), (4, "w " * 50_000, 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, none).collect()
    assert len(rows) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    assert toxicity.toxicity(docs.limit(0), none).collect() == []
    some = spark.createDataFrame([(4, 1), (4, None), (None, 1), (4, 0), (99, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, some).count() == 5


def test_ftrl_step():
    m = toxicity.Ftrl(3, alpha=0.5, beta=1.0, l1=0.1, l2=0.0)
    m.learn(np.array([0, 3]), 1)
    assert m.z[0] == pytest.approx(-0.5) and m.n[0] == pytest.approx(0.25)
    assert m.weights(np.array([0]))[0] == pytest.approx((0.5 - 0.1) / ((1 + 0.5) / 0.5))
    assert m.weights(np.array([1]))[0] == 0
