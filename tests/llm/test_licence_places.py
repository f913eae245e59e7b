"""Templates within longer documents and lines."""

import pytest

from larkspur.llm import licences as L
from tests.llm import test_licences
from tests.llm.test_licences import bigrams, words

BY = {n: t for n, _, t in L.TEMPLATES}


def places(text, threshold=0.8):
    """(licence, template, score) of the runs of words that match, the best of those that overlap."""
    w, found = words(text or ""), []
    for i, (name, spdx, t) in enumerate(L.TEMPLATES):
        own, n = bigrams(words(t)), len(words(t))
        for at in range(len(w) - 1):
            if (w[at], w[at + 1]) in own:
                x = bigrams(w[at : at + n])
                if (score := 2 * len(x & own) / (len(x) + len(own))) >= threshold:
                    found.append((score, -i, -at, name, spdx, min(at + n, len(w))))
    kept = []
    for x in sorted(found, reverse=True):
        if all(-x[2] >= y[5] or -y[2] >= x[5] for y in kept):
            kept.append(x)
    return kept


def texts():
    mit, cut = BY["mit"], (BY["mit"].index("The above"), BY["mit"].index("THE SOFTWARE IS"))
    usual = f"Copyright 2020 X\n\n{mit[: cut[0]]}\n\n{mit[cut[0] : cut[1]]}\n\n{mit[cut[1] :]}\n\n"
    code = "\n".join(f"x{i} = f{i}(y{i})" for i in range(200))
    return [
        ("MIT", usual + code), ("MIT", "Copyright 2020 Foo. Released under the MIT License. See LICENSE."), ("CC-BY-NC-SA-4.0", "all texts here are licensed under CC BY-NC-SA 4.0. more of it " + "word " * 50),
        ("BSD-2-Clause,GPL-2.0", code + BY["bsd-2"].replace("HOLDERS", "OWNERS") + " and also " + BY["gpl2-notice"] + code), ("", "nothing of the kind, released under the table " * 40), ("", None), ("", "word"),
    ]


def test_templates_within_texts(spark):
    own = [t for _, t in texts()] + test_licences.texts()
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    out = L.scan_all(df)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(own):
        unit, found = test_licences.brute(t), places(t)
        r = got[i]
        assert (r.n_units, r.n_places) == (unit[3], len(found)), (i, t)
        assert r.licences == ",".join(sorted({x[4] for x in found} | set(filter(None, unit[4].split(","))))), (i, t)
        assert r.score == pytest.approx(max([unit[2], *(x[0] for x in found)]))
    assert [got[i].licences for i in range(len(texts()))] == [x for x, _ in texts()]
    old = {r.doc_id: r.licences for r in L.scan(df).collect()}
    assert [old[i] for i in range(4)] == ["", "", "", "BSD-2-Clause"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
