import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality
from larkspur.llm.text import sql_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit.update(range(i, i + 5))
    dup, before = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def norm(line):
    return " ".join(WORD.findall(line)).lower()


def brute(docs, min_docs=20, share=0.02):
    """docs: (id, text, host). id: (base, failed, kept, cleaned)."""
    count, hosts = defaultdict(Counter), Counter(h for *_, h in docs)
    for _, text, host in docs:
        count[host].update({norm(x) for x in (text or "").split("\n") if WORD.search(x)})
    out = {}
    for i, text, host in docs:
        b = base(text)
        frequent = lambda x: WORD.search(x) and count[host][norm(x)] > max(min_docs, hosts[host] * share)  # noqa: B023, E731
        gone = [x for x in (text or "").split("\n") if frequent(x)]
        left = b[0] - sum(len(WORD.findall(x)) for x in gone)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        cleaned = None if text is None else "\n".join(x for x in text.split("\n") if not frequent(x))
        out[i] = b, failed, not failed and not (gone and (left < 10 or left < 0.5 * b[0])), cleaned
    return out


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_against_brute_force(spark, sf):
    import __spark_entry__

    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    want = brute(docs)
    got = __spark_entry__.queries()["op9_quality"](spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(docs)
    for r in got:
        b, failed, kept, _ = want[r.doc_id]
        assert ((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept) == (b, failed, kept), r


def test_frequent_lines_and_edges(spark):
    docs = [(i, f"unique words of document number {i} run to ten or more of them here\nShare  THIS\tpage now", "h") for i in range(40)]
    docs += [(100 + i, "share this page now\nshare this page now and some other words that are its own", "h") for i in range(3)]
    docs += [(200, None, "h"), (201, "", "h"), (202, "share this page now", None), (203, "a\x0bb " * 50, None), (204, "\n\n \n", "h"), (205, "x y z " * 3000, "q")]
    want = brute(docs)
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, source string, kept string, _n int").withColumn("n_words", F.lit(1))
    got = quality.line_frequency(df).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.cleaned, r.kept, r.base_failed) == (want[r.doc_id][3], want[r.doc_id][2], want[r.doc_id][1]), r
    assert sum(r.n_frequent_lines for r in got) >= 43
    assert quality.line_frequency(df.limit(0)).collect() == []


def test_repeated_words_by_brute_force(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc" if k % 3 else "ab") for _ in range(rng.randint(0, 60))) for k in range(300)] + ["é\x0c" * 30, " a b c d e ", "a b c d e\ta b c d e"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.repeated_words(sql_words(F.col("t"))).alias("n")).collect()
    assert all(r.n == base(r.t)[4] for r in rows)


def test_repeated_ids_against_sql(spark, tmp_path):
    """Lines count by distinct documents, as the query's SQL does."""
    import duckdb

    from larkspur.llm.oracle import QUALITY

    text = "one common line of words here\nanother line {} of quite a few other words that are its own {}"
    rows = [(1, text.format(i, i), "h") for i in range(30)] + [(100 + i, text.format(i, -i) + "\nin many documents", "g") for i in range(25)]
    rows += [(None, text.format("n", "m"), "h"), (None, None, None), (7, "in many documents", "g"), (7, "in many documents", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.line_frequency(df).select("doc_id", "n_frequent_lines", "words_left", "kept").collect()
    assert len(got) == len(rows) and {r.n_frequent_lines for r in got if r.doc_id == 1} == {0}
    assert all(r.n_frequent_lines == 2 for r in got if (r.doc_id or 0) >= 100) and {r.n_frequent_lines for r in got if r.doc_id == 7} == {1}
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, any_value(text) AS text, any_value(source) AS source FROM read_parquet('{tmp_path}/d/*.parquet') WHERE doc_id <> 1 GROUP BY doc_id")
    sql = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_frequent_lines, words_left, kept FROM ({QUALITY})").fetchall() if r[0]}
    once = df.where("doc_id <> 1").dropDuplicates(["doc_id"])
    assert {r.doc_id: tuple(r)[1:] for r in quality.line_frequency(once).select("doc_id", "n_frequent_lines", "words_left", "kept").collect()} == sql
