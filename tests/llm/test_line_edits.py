"""Copies of prose lines that differ in one character, and lines of few distinct shingles."""

import random

import corpus_pipeline as P
from larkspur.llm import lines as L
from larkspur.llm import queries
from tests.llm.test_lines import brute, shingles


def edited(seed, lengths):
    """(id, text): lines of these lengths, and behind them each with one character changed in the middle."""
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(n)) for n in lengths]
    other = [x[: len(x) // 2] + "z" + x[len(x) // 2 + 1 :] for x in lines]
    return list(enumerate(lines + other))


def test_one_character_links_prose_lines(spark, monkeypatch):
    docs = edited(4, [49, 52, 55, 58, 61, 64, 67, 70, 73, 76, 78] * 3)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(queries, "read", lambda *_: df)
    got = {r.doc_id: (r.n_lines, r.removed) for r in queries.op4_lines(spark, "").collect()}
    want, half = brute(docs, 5), len(docs) // 2
    assert all(want[i] == (1, [0] * (i >= half)) for i in want)
    assert sum(got[i] != want[i] for i in want) <= 2
    kept = {r.doc_id for r in dict(P.STAGES)["lines"](spark, df, "").collect()}
    assert len(kept ^ set(range(half))) <= 2


def test_equal_sets_share_all_bands():
    like = [("-" * 60, "-" * 100), ("=" * 70, "=" * 5000), ("ab" * 35, "ab" * 300), ("- * + " * 12, "- * + " * 40)]
    for x, y in like:
        for k in (5, 8):
            line, key = L.band_keys([x, "some other line", y], k, 26, 7)
            assert shingles(x, k) == shingles(y, k) and set(key[line == 0].tolist()) == set(key[line == 2].tolist())


def test_separators_and_periodic_lines(spark):
    docs = list(enumerate(["-" * 60, "-" * 100, "ab" * 35, "ab" * 90, "- * + " * 12, "- * + " * 40, "a line of its own"]))
    for k in (5, 8):
        got = {r.doc_id: (r.n_lines, r.removed) for r in L.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), k=k).collect()}
        assert got == brute(docs, k) and sum(len(gone) for _, gone in got.values()) == 3
