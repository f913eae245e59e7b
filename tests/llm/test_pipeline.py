from collections import Counter

from tests.llm import test_lines, test_ngram_join, test_packing, test_quality

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(P.STAGES)
    assert list(stages) == ["quality", "lines", "near", "mix", "pack"]
    now = {r.doc_id: r for r in docs.collect()}

    want = test_quality.brute([(r.doc_id, r.text, r.source) for r in now.values()])
    out = stages["quality"](spark, docs, SF)
    assert out.columns == columns
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == {i: w[3] for i, w in want.items() if w[2]}
    assert all(r.n_chars == len(r.text) and r.source == now[r.doc_id].source for r in got.values())

    docs, now = spark.createDataFrame(list(got.values()), docs.schema), got
    removed = test_lines.brute([(r.doc_id, r.text) for r in now.values()])
    out = stages["lines"](spark, docs, SF)
    assert out.columns == columns
    got = {r.doc_id: r for r in out.collect()}
    left = {i: "\n".join(x for k, x in enumerate(now[i].text.split("\n")) if k not in set(gone)) for i, (n, gone) in removed.items() if not n or len(gone) < n}
    assert sum(got[i].text != left[i] if i in got else 1 for i in left) <= 1 and abs(len(got) - len(left)) <= 1

    # a few near copies that are left over, so that the next stage has some
    rows = list(got.values())
    rows += [r.__class__(*[9000 + k if c == "doc_id" else r.text.replace(" ", "  ", 1) + " tail" if c == "text" else r[c] for c in columns]) for k, r in enumerate(rows[:9])]
    docs, now = spark.createDataFrame([tuple(r) for r in rows], docs.schema), {r[0]: r for r in rows}
    sets = {i: test_ngram_join.shingles(r[1], 5) for i, r in now.items()}
    group = {i: min([j for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], default=i) for i in sets}
    out = stages["near"](spark, docs, SF)
    assert out.columns == columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {i for i, j in group.items() if i == j} and len(got) < len(now)

    docs = spark.createDataFrame(list(got.values()), docs.schema)
    out = stages["mix"](spark, docs, SF)
    assert out.columns == columns
    mixed = [tuple(r) for r in out.collect()]
    assert set(mixed) <= {tuple(r) for r in got.values()} and max(Counter(mixed).values()) <= 2
    size = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert abs(size(mixed) - 1.5 * size(got.values())) < 0.1 * size(got.values())

    copies = {i: k for i, k in Counter(r[0] for r in mixed).items()}
    once = [(i, t) for i, t in {(r[0], r[1]) for r in mixed} if copies[i] == 1]
    packed = stages["pack"](spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    test_packing.check(stages["pack"](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in got.values()])
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    total = {r.doc_id: r.doc_tokens for r in packed}
    assert all(tokens[i] == copies[i] * total[i] for i in copies) and once


def test_run(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert rows and all(r.length > 0 for r in rows)
    again = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    key = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert key(rows) == key(again)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []


def test_nulls(spark):
    text = "a line of some ten or more words that are all different\nand another line"
    rows = [(1, text, "en", "x", 1), (None, text + " too", None, None, None), (2, None, "en", "x", 0), (3, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        got = stage(spark, docs, SF).collect()
        assert got, name
