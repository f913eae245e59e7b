import random
import re

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(docs, num=90, den=100):
    """docs: (id, text). (id, set size, least id that links reach) of each."""
    sets = [shingles(t) for _, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(docs[a][0]), root(docs[b][0])))
                parent[y] = x
    return sorted((i, len(s), root(i)) for (i, _), s in zip(docs, sets))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + rng.randint(0, 2)] = [f"e{rng.random()}" for _ in range(rng.randint(0, 2))]
    return words


def family(seed, n_docs=150):
    rng = random.Random(seed)
    texts = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(rng.choice((1, 2, 3, 12, 30, 100, 300)))] for _ in range(25)]
    out = []
    while len(out) < n_docs:
        w = rng.choice(texts)
        if rng.random() < 0.8 and len(w) > 5:
            w = edited(rng, w, rng.randint(0, max(1, len(w) // 40)))
            if rng.random() < 0.4:
                texts.append(w)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("seed", "chunk_chars", "most"), [(1, 3_000, 4096), (2, 10**7, 3)])
def test_random_families_against_brute_force(spark, seed, chunk_chars, most):
    docs = list(enumerate(family(seed)))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, chunk string")
    got = sorted(map(tuple, J.jaccard_links(df, chunk_chars=chunk_chars, most=most).collect()))
    want = brute(docs)
    assert got == want
    assert sum(c != i for i, _, c in want) > 30


def test_chain_whose_members_do_not_link_with_the_least(spark):
    """Each differs from the next by a few words, so ends are unlike; blocks hold pairs that the least member never sees."""
    words = [f"w{i}" for i in range(200)]
    docs = []
    for k in range(30):
        docs.append((k, " ".join(words)))
        words = list(words)
        words[(k * 7) % 190] = f"x{k}"
    order = list(range(30))
    random.Random(0).shuffle(order)
    docs = [(order[i], t) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_links(df).collect())) == brute(docs)


def test_keys_share_a_block_whenever_sets_link():
    rng, classes = np.random.RandomState(0), J.Classes(90, 100)
    linked = 0
    for _ in range(3000):
        n = rng.randint(1, 200)
        s = rng.randint(0, 2**62, n).astype(np.uint64)
        drop, add = rng.randint(0, n // 15 + 2), rng.randint(0, n // 15 + 2)
        t = np.unique(np.concatenate([s[min(drop, n - 1) :], rng.randint(0, 2**62, add).astype(np.uint64)]))
        s = np.unique(s)
        overlap = len(np.intersect1d(s, t))
        if 100 * overlap >= 90 * (len(s) + len(t) - overlap) and not np.array_equal(s, t):
            linked += 1
            assert len(set(J.block_keys(s, classes).tolist()) & set(J.block_keys(t, classes).tolist())) >= J.SHARED
            assert overlap >= classes.need(len(s), len(t))
            assert J.overlap_bound(J.point(s), J.point(t)) >= overlap
    assert linked > 300


def test_large_sets_have_wide_points():
    rng = np.random.RandomState(5)
    s, t = (np.unique(rng.randint(0, 2**62, n).astype(np.uint64)) for n in (9000, 7600))
    part = np.unique(np.concatenate([s[:6000], t[:1500]]))
    assert (len(J.point(s)), len(J.point(t)), len(J.point(s[:50]))) == (2048, 1024, 256)
    assert J.point(s).sum() == 9000 and (J.folded(J.point(s), 256) == J.point(s, 256)).all()
    classes = J.Classes(80, 100)
    assert J.overlap_bound(J.point(s), J.point(t)) < classes.need(len(s), len(t))
    assert J.overlap_bound(J.point(s), J.point(part)) >= 6000


def test_tree_finds_what_a_scan_finds():
    rng, classes = np.random.RandomState(1), J.Classes(90, 100)
    base = [np.unique(rng.randint(0, 2**62, rng.randint(20, 400)).astype(np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate([b[rng.rand(len(b)) > 0.03], rng.randint(0, 2**62, 3).astype(np.uint64)])) for b in base for _ in range(12)]
    points, sizes = np.array([J.point(s) for s in sets]), np.array([len(s) for s in sets])
    tree = J.RTree(points, sizes)
    for k in range(0, len(sets), 7):
        n = sizes[k]
        ok = (90 * n <= 100 * sizes) & (90 * sizes <= 100 * n) & (np.minimum(points, points[k]).sum(1) >= classes.need(n, sizes))
        assert sorted(tree.search(points[k], int(n), classes).tolist()) == np.flatnonzero(ok).tolist()


@pytest.mark.parametrize("threshold", [(80, 100), (2, 3), (1, 1)])
def test_other_thresholds(spark, threshold):
    docs = list(enumerate(family(9, 90)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_links(df, threshold=threshold).collect())) == brute(docs, *threshold)


def test_edges(spark):
    docs = [(5, "a b c d"), (5, "A  b\tc d"), (7, "a b c d"), (None, "a b c d"), (8, None), (9, ""), (9, " \n"), (10, "x"), (11, "X"), (12, "é É"), (13, "long " * 20_000), (14, "long " * 5)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, id int")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in J.jaccard_links(df).collect())
    assert got == [((False, 5), 2, 5), ((False, 5), 2, 5), ((False, 7), 2, 5), ((False, 8), 0, 8), ((False, 9), 0, 9), ((False, 9), 0, 9), ((False, 10), 1, 10), ((False, 11), 1, 10), ((False, 12), 1, 12), ((False, 13), 1, 13), ((False, 14), 1, 13), ((True, 0), 2, 5)]
    assert J.jaccard_links(df.limit(0)).collect() == []


def test_sets_are_those_of_words():
    texts = ["A b c a b C", None, "x", "x y", "", "a b c"]
    got = [len(s) for s in J.shingle_sets(pa.array(texts), 3)]
    assert got == [len(shingles(t)) for t in texts]


def test_query_against_brute_force(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, __spark_entry__.queries()["op5_ngram_join"](spark, d).collect()))
    assert got == brute(docs)


@pytest.mark.parametrize("num", [80, 90])
def test_unlike_sets_share_no_block(num):
    """Nothing in common, no key in common: blocks don't grow with the corpus."""
    rng, classes = np.random.RandomState(num), J.Classes(num, 100)
    for n, sets in ((6, 3000), (15, 2000), (100, 1000), (1000, 400)):
        keys = np.concatenate([np.unique(J.block_keys(np.unique(rng.randint(0, 2**62, n).astype(np.uint64)), classes)) for _ in range(sets)])
        assert len(np.unique(keys)) == len(keys), n
