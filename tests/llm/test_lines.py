import random

import numpy as np
import pytest

from larkspur.llm import lines as L


def shingles(line, k):
    return {line[i : i + k] for i in range(len(line) - k + 1)} or {line}


def alike(x, y, num, den):
    both = len(x & y)
    return den * both >= num * (len(x) + len(y) - both)


def brute(docs, k=5, num=80, den=100):
    """docs: (id, text), ids distinct and not null. id: (lines with a word, numbers that go)."""
    each = [(i, n, line.decode()) for i, t in docs for n, line in L.normal_lines(t)]
    own = sorted({x for *_, x in each})
    sets = [shingles(x, k) for x in own]
    parent = list(range(len(own)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            if num * len(sets[a]) <= den * len(sets[b]) and num * len(sets[b]) <= den * len(sets[a]) and alike(sets[a], sets[b], num, den):
                parent[root(a)] = root(b)
    of = {x: root(i) for i, x in enumerate(own)}
    first = {}
    for i, n, x in sorted(each):
        first.setdefault(of[x], (i, n))
    out = {i: (0, []) for i, _ in docs}
    for i, n, x in sorted(each):
        total, gone = out.get(i, (0, []))
        out[i] = total + 1, gone + [n] * (first[of[x]] != (i, n))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdfgst") for _ in range(rng.randint(2, 9)))
    lines = [" ".join(word() for _ in range(rng.choice((1, 2, 4, 10, 25, 40, 70)))) for _ in range(n)]
    docs = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(lines)
            if rng.random() < 0.5:
                x = list(x)
                for _ in range(rng.randint(1, 1 + len(x) // 60)):
                    x[rng.randrange(len(x))] = rng.choice("xyz ")
                x = "".join(x)
                lines.append(x)
            own.append(rng.choice(("", " ")) + (x.upper() if rng.random() < 0.1 else x))
            if rng.random() < 0.2:
                own.append("  ")
        docs.append((i, "\n".join(own)))
    return docs


@pytest.mark.parametrize(("seed", "chunk_chars", "most"), [(1, 3_000, 1024), (2, 10**7, 4)])
def test_against_brute_force(spark, seed, chunk_chars, most):
    docs = corpus(seed, 120)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, line int")
    got = {r.doc_id: (r.n_lines, r.removed) for r in L.duplicate_lines(df, chunk_chars=chunk_chars, most=most).collect()}
    want = brute(docs)
    assert set(got) == set(want)
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 2 and sum(len(g) for _, g in want.values()) > 100


def test_applied(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away from all of the hounds"
    docs = [(1, f"{a}\nown line of one"), (2, f"first of two\n\n{a.replace('lazy', 'lazi').upper()}\nlast of two"), (3, a), (4, None), (None, f"{a}\nq"), (None, "own line of one\nq"), (5, ""), (6, "x" * 60_000)]
    df = spark.createDataFrame([(*d, "c", 9) for d in docs], "doc_id long, text string, _n string, line int")
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect()]
    want = [(1, docs[0][1], 2, 0), (2, "first of two\n\nlast of two", 3, 1), (3, "", 1, 1), (4, None, 0, 0), (5, "", 0, 0), (6, "x" * 60_000, 1, 0)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key)[:6] == want
    assert sorted(got, key=key)[6:] == [(None, "", 2, 2), (None, "q", 2, 1)]  # of two with no id, one keeps the line that both have
    assert L.dedup_lines(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [20, 49, 90, 240, 600, 1500])
def test_like_lines_share_a_band(n):
    """Pairs as unlike as links may be, by length."""
    rng, lines = random.Random(n), []
    while len(lines) < 600:
        x = [rng.choice("etaoinshrdlu bcf") for _ in range(n)]
        y, z = None, x[:]
        while alike(shingles("".join(x), 5), shingles("".join(z), 5), 80, 100):
            y, z = z, z[:]
            z[rng.randrange(n)] = rng.choice("qxz")
        lines += ["".join(x), "".join(y)] if y and y != x else ["x" * 30] * 2
    miss = 0
    for i in range(0, len(lines), 200):
        line, key = L.band_keys(lines[i : i + 200], 5, 26, 7)
        own = [set(key[line == j].tolist()) for j in range(200)]
        miss += sum(not own[j] & own[j + 1] for j in range(0, 200, 2))
    assert miss <= 3


def test_compared_as_sets_are():
    rng = random.Random(8)
    lines = ["ab", "", "abababab", "x" * 700]
    for _ in range(60):
        x = "".join(rng.choice("abcdef ") for _ in range(rng.choice((3, 20, 80, 900))))
        lines += [x, x[: len(x) * 9 // 10], x + x, x[::-1], x[3:]]
    x, y = (np.array([rng.randrange(len(lines)) for _ in range(2000)]) for _ in range(2))
    y[::2] = np.minimum(x[::2] + 1, len(lines) - 1)
    for num in (50, 80, 100):
        got = L.jaccard_links(lines, x, y, 5, num, 100)
        assert got.tolist() == [alike(shingles(lines[i], 5), shingles(lines[j], 5), num, 100) for i, j in zip(x, y)] and got.sum() > 5


def test_slots_agree_by_jaccard_index():
    rng, line = random.Random(5), lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    for n in (12, 60, 400, 3000):
        x = line(n)
        y = x[: n * 2 // 3] + line(n - n * 2 // 3)
        a, b = shingles(x, 5), shingles(y, 5)
        got = L.minima(*L.shingle_hashes([x, y, line(50)], 5), 2000)
        assert abs((got[0] == got[1]).mean() - len(a & b) / len(a | b)) < 0.05
    same = L.band_keys(["abc", "abc", ""], 5, 26, 7)
    assert (same[1][same[0] == 0] == same[1][same[0] == 1]).all() and len(np.unique(same[0])) == 3


def test_documents_are_rows(spark):
    """Rows that repeat an id or a whole row, nulls and empty texts: a row each."""
    a, b = "one line of words that many have", "another line of quite other words"
    docs = [(1, f"{a}\n{b}"), (1, f"{b}\n{a}\nunlike the others, this stays"), (1, f"{a}\n{b}"), (None, a), (None, None), (2, None), (3, ""), (4, " \n\t")]
    got = sorted((str(r.doc_id), r.n_lines, r.removed) for r in L.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    rest = [("2", 0, []), ("3", 0, []), ("4", 0, []), ("None", 0, []), ("None", 1, [0])]
    assert [r for r in got if r[0] != "1"] == rest
    mine = [r for r in got if r[0] == "1"]
    assert [r[1] for r in mine] == [2, 2, 3] and mine[0] == mine[1]
    # line 0 of either text is the first with its line, so each keeps that one
    assert mine[0][2] == [1] and mine[2][2] == [1]


def test_query(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_lines, r.removed) for r in __spark_entry__.queries()["op4_lines"](spark, d).collect()}
    want = brute(docs)
    assert sum(got[i] != want[i] for i in want) <= 1 and len(got) == len(want)


def test_rolling_hashes_runs():
    rng = np.random.RandomState(2)
    x = rng.randint(0, 4, 400).astype(np.uint64)
    for k in range(1, 14):
        h, seen = L.rolling(x, k), {}
        assert len(h) == len(x) - k + 1
        for i in range(len(h)):
            assert seen.setdefault(tuple(x[i : i + k]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)
