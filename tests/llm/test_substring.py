import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import substring


def brute(docs, width=50):
    """docs: (id, text). (id, n_words, n_removed, sha256) of each."""
    late = float("inf")
    first = {}
    split = [(late if i is None else i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, late), i)
    out = []
    for (i, w), (own, _) in zip(split, docs):
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


key = lambda r: (r[0] is None, r[0] or 0, r[1:])


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 4999), max_size=200), st.randoms())
def test_codes_round_trip(cells, rng):
    cells = np.array(sorted(cells), np.int64)
    several = np.array([rng.random() < 0.5 for _ in cells], bool)
    got, bits = substring.unpack_cells(substring.pack_cells(cells, several, 5000), 5000)
    assert (got == cells).all() and (bits == several).all()


def test_windows_do_not_cross_documents():
    text, start, counts, (h,) = substring.windows(pa.array(["a b c d", None, "", "b c d", "b", " a\tb\x0bc "]), 3, (0,))
    assert text.tolist() == [0, 0, 3, 5] and start.tolist() == [0, 1, 0, 0] and counts.tolist() == [4, 0, 0, 3, 1, 3]
    assert h[1] == h[2] and h[0] == h[3] and len(set(h.tolist())) == 2


@pytest.mark.parametrize("chunk_chars", [300, 10_000_000])
def test_random_against_brute_force(spark, chunk_chars):
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(3, 20))) for _ in range(6)]
    docs = [(rng.randrange(60), " ".join(rng.choice(passages) if rng.random() < 0.6 else f"u{rng.random()}" for _ in range(rng.randint(0, 9)))) for _ in range(80)]
    docs += [(None, docs[0][1]), (None, passages[0] + " tail"), (200, None), (201, ""), (201, ""), (202, "\x0b".join(passages) + " é")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, chunk int")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(df, width=8, chunk_chars=chunk_chars).collect()]
    assert sorted(got, key=key) == sorted(brute(docs, 8), key=key)


def test_narrow_sketch_loses_none(spark):
    """Cells that nearly all windows share only make the second pass group more."""
    docs = [(i, " ".join(str((i // 3) * 100 + k) for k in range(60))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(df, spread=0, depth=1, chunk_chars=500).collect()]
    assert sorted(got, key=key) == sorted(brute(docs), key=key)
    assert substring.dedup_substrings(df.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in __spark_entry__.queries()["op2_substring"](spark, d).collect()]
    assert sorted(got, key=key) == sorted(brute(docs), key=key)
    assert sum(r[2] for r in got) > 0
