import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import lattice

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(docs):
    train = [tokens(t) for i, t in docs if not held(i)]
    c = Counter(w for t in train for w in t)
    n, v, end = sum(c.values()) + len(train), len(c) + bool(train), len(train)
    f = lambda k: math.log10((k + 1) / (n + v + 1))
    return [(i, held(i), len(tokens(t)) + 1, sum(c[w] > 0 for w in tokens(t)) + (end > 0), n, sum(f(c[w]) for w in tokens(t)) + f(end)) for i, t in docs]


def segmentations(s, pieces):
    if not s:
        yield ()
    for k in range(1, len(s) + 1):
        if s[:k] in pieces:
            for rest in segmentations(s[k:], pieces):
                yield (s[:k], *rest)


def test_forward_sums_all_segmentations():
    pieces = ["", "▁", "a", "b", "ab", "▁a", "ba", "▁aba", "", ""]
    weights = np.array([0, 0.1, 0.2, 0.1, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])
    own = lattice.Lattice(pieces, {0xC3: 8, 0xA9: 9}, weights)
    p, words = dict(zip(pieces, weights)), ["a", "ab", "abab", "aabba", "b", "ab"]
    times, counts, want = np.array([3.0, 1, 2, 5, 1, 4]), np.zeros(10), np.zeros(10)
    got = np.exp(own.words(words))
    own.expect(words, times, counts)
    for word, n, value in zip(words, times, got):
        ways = [(way, math.prod(p[x] for x in way)) for way in segmentations("▁" + word, set(pieces) - {""})]
        total = sum(w for _, w in ways)
        assert value == pytest.approx(total)
        for way, w in ways:
            for x in way:
                want[pieces.index(x)] += n * w / total
    assert counts == pytest.approx(want)
    assert np.exp(own.words(["é", "aé"])) == pytest.approx([0.1 * 0.05 * 0.05, (0.1 * 0.2 + 0.1) * 0.05 * 0.05])
    spelled = np.zeros(10)
    own.expect(["é"], np.array([2.0]), spelled)
    assert spelled[[8, 9, 1]].tolist() == [2, 2, 2]
    assert math.isfinite(own.words(["ab" * 20_000])[0]) and len(own.words([])) == 0


def test_expectation_raises_the_likelihood(spark):
    words = spark.createDataFrame([("hello", 50), ("helo", 3), ("world", 40), ("é", 2)], "word string, n long")
    from larkspur.llm.queries import vocabulary

    path, got = vocabulary("piece_bpe_32k.model"), []
    for rounds in (0, 1, 3):
        w, end = lattice.fit(words, 10, path, rounds, 0.01)
        own = lattice.Lattice(*lattice.read_vocabulary(path)[:2], w)
        assert w.sum() <= 1 + 1e-9
        got.append(float(own.words(["hello", "helo", "world", "é"]) @ [50, 3, 40, 2]))
    assert got[0] < got[1] < got[2]


def test_query_against_brute_force(spark):
    import __spark_entry__
    from larkspur.llm.queries import vocabulary

    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in __spark_entry__.queries()["op10_lattice"](spark, d).collect()}
    for i, h, n, k, total, score in base(docs):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, k, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert len(got) == len(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    untrained = {r.doc_id: r for r in lattice.lattice_scores(table, vocabulary("piece_bpe_32k.model"), rounds=0).collect()}
    unseen = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].score for i in unseen) > 0.9 * sum(untrained[i].score for i in unseen)


def test_edges(spark):
    from larkspur.llm.queries import vocabulary

    path = vocabulary("piece_bpe_32k.model")
    docs = [(None, "A b"), (1, None), (1, None), (2, ""), (3, "日本 ﷽ \x1c x\x0by"), (4, "w" * 30_000), (5, "É a")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, score string")
    got = lattice.lattice_scores(df, path, chunk_chars=1000).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for r, want in zip(sorted(got, key=key), sorted(base(docs), key=key), strict=True):
        assert tuple(r)[:5] == want[:5] and r.base_score == pytest.approx(want[5]) and math.isfinite(r.score)
    assert lattice.lattice_scores(df.limit(0), path).collect() == []
    only = lattice.lattice_scores(spark.createDataFrame([(i, "q") for i in range(100) if held(i)], "doc_id long, text string"), path).collect()
    assert only and all(r.n_known == 0 and r.train_tokens == 0 for r in only)


def test_score_against_brute_force(spark):
    from larkspur.llm.queries import vocabulary

    path = vocabulary("piece_bpe_32k.model")
    texts = ["Hello world", "hell o\nworld", "the cat", "THE mat  the", None, "", "a", "tab\tle table", "lat", "he is at sea"]
    docs = [(i, texts[i % len(texts)]) for i in range(40)]
    pieces, _, first = lattice.read_vocabulary(path)
    place = {p: i for i, p in enumerate(pieces) if p}
    train = [tokens(t) for i, t in docs if not held(i)]
    count, own, end = Counter(w for t in train for w in t), first, len(train) + 0.1

    def ways(word, weights):
        return [(way, math.prod(weights[place[x]] for x in way)) for way in segmentations("▁" + word, place)]

    for _ in range(2):
        want = first * 0.1 * len(first)
        for word, n in count.items():
            found = ways(word, own)
            total = sum(v for _, v in found)
            for way, v in found:
                for x in way:
                    want[place[x]] += n * v / total
        own = want / (want.sum() + end)
    last = math.log10(end / (end + want.sum()))
    got = {r.doc_id: r.score for r in lattice.lattice_scores(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()}
    for i, t in docs:
        assert got[i] == pytest.approx(last + sum(math.log10(sum(v for _, v in ways(w, own))) for w in tokens(t)), rel=1e-9)
    assert sum(held(i) for i, _ in docs) > 2
