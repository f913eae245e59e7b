import re

import pytest

from larkspur.llm import licences as L


def words(t):
    return re.findall("[a-z0-9]+", t.lower())


def bigrams(w):
    return set(zip(w, w[1:]))


def brute(text, threshold=0.8):
    """(licence, template, score, units that match, all licences) by comparing every unit with every template."""
    text = text or ""
    units = dict.fromkeys([text, *re.split(r"\n[\x20\x09-\x0D]*\n", text), *text.split("\n")])
    own = [(n, s, bigrams(words(t))) for n, s, t in L.TEMPLATES]
    matches = []
    for u in units:
        b = bigrams(words(u))
        scores = [(2 * len(b & t) / (len(b) + len(t)), -i, n, s) for i, (n, s, t) in enumerate(own)] if b else []
        best = max((x for x in scores if x[0] >= threshold), default=None)
        if best:
            matches.append(best)
    best = max(matches, default=(0.0, 0, None, None))
    return best[3], best[2], best[0], len(matches), ",".join(sorted({m[3] for m in matches}))


def rows(df):
    return [(r.doc_id, r.licence, r.template, r.score, r.n_units, r.licences) for r in df.collect()]


def texts():
    by = {n: t for n, _, t in L.TEMPLATES}
    wrapped = "\n".join(by["mit"][i : i + 70] for i in range(0, len(by["mit"]), 70))
    return [
        by["mit"], f"Copyright 2020 X\n\n{wrapped}\n\ncode follows here\nmore code", by["apache-header"].upper().replace(" ", "\n * "), by["bsd-2"].replace("HOLDERS", "OWNERS"),
        "prose before\nLicensed under CC BY-NC 3.0.\nprose after\n\nReleased under the MIT Licence.", "Licensed", "", None, " \n \n", "nothing of the kind here", by["gpl3-header"] + " " + by["isc"],
        "the same the same the same the same " * 2000, "İ licensed under the apache license, version 2.0 é", *[t for _, _, t in L.TEMPLATES], *[" ".join(t.split()[: len(t.split()) * 4 // 5]) for _, _, t in L.TEMPLATES],
    ]


def test_against_brute_force(spark):
    own = list(enumerate(texts()))
    df = spark.createDataFrame([(*t, 1, "x") for t in own], "doc_id long, text string, score int, licence string")
    got = {r[0]: r[1:] for r in rows(L.scan(df))}
    for i, t in own:
        want = brute(t)
        assert got[i][:2] == want[:2] and got[i][2] == pytest.approx(want[2]) and got[i][3:] == want[3:], (i, t)
    assert got[0][0] == got[1][0] == "MIT"


def test_bounds_leave_out_only_templates_that_cannot_match():
    for t in (0.5, 0.8, 0.95):
        for m in range(1, 60):
            lo, hi = L.bounds(m, t)
            for n in range(1, 200):
                assert (lo <= n <= hi) == (2 * min(m, n) / (m + n) >= t - 1e-12)


def test_edges(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License."), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(rows(L.scan(df)), key=str) == sorted([(None, "MIT", "mit-notice", 1.0, 1, "MIT"), (1, None, None, 0.0, 0, ""), (1, None, None, 0.0, 0, "")], key=str)
    assert rows(L.scan(df.limit(0))) == []
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_query_against_brute_force(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.001"
    docs = dict(map(tuple, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()))
    got = rows(__spark_entry__.queries()["op8_licences"](spark, d))
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r[0]])
        assert r[1:3] == want[:2] and r[3] == pytest.approx(want[2]) and r[4:] == want[3:]
