"""The mixture's rows lie as the splitting tree and the hashed order deal them."""

from itertools import groupby

import corpus_pipeline as P
from larkspur.llm import mixing, queries


def documents(spark, n=600):
    return spark.createDataFrame([(i, f"w{i} " * (1 + i % 13), "en", "abc"[3 * i // n], 1) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")


def test_draw_lays_rows_out(spark):
    parts = mixing.draw(documents(spark), shards=8).rdd.glom().collect()
    runs = [(s, [r.mix_order for r in g]) for part in parts for s, g in groupby(part, key=lambda r: r.mix_shard)]
    assert sorted(s for s, _ in runs) == list(range(8))
    assert all(own == sorted(own) for _, own in runs)


def test_stage_keeps_the_layout(spark):
    docs = documents(spark)
    laid = [(r.doc_id, r.mix_shard) for r in mixing.draw(docs).collect()]
    out = P.mix_stage(spark, docs, "")
    got = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and got == [i for i, _ in laid]
    twins = sum(a == b for a, b in zip(got, got[1:]))  # copies of a document went side by side before
    assert twins < len(got) // 20
    assert [s for s, _ in groupby(s for _, s in laid)] == list(dict.fromkeys(s for _, s in laid))


def test_query_has_the_shards(spark):
    d = "/root/testdata/sf0.001"
    rows = queries.op6_mixing(spark, d).collect()
    assert all(len(r.shards) * r["size"] == r.taken and all(0 <= s < 64 for s in r.shards) for r in rows)
    assert len({s for r in rows for s in r.shards}) > 32
