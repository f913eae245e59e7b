import zlib
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm.packing import pack_documents
from larkspur.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, tier string"


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs):
    """Every id in exactly one piece; offsets gapless; lengths at tiers but for the padded."""
    want = dict(zip([d for d, _ in docs], ids_of([t or "" for _, t in docs]), strict=True))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(want[doc][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want[doc])
    short = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        short += at not in (256, 512, 1024, 2048)
    return short


def test_round_trip(spark):
    rng = np.random.RandomState(1)
    words = ["the", "of", "Ünder", "don't", "12", "|", "naïve", "x" * 40, "\n\n", "  ", "日本", "'s", "\t", "a b", "\x1c", "😀"]
    docs = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([0, 1, 3, 7, 50, 200, 900, 3000, *rng.randint(1, 700, 60)])]
    docs += [(900, None), (901, "<|endoftext|> as text"), (902, "   "), (903, "\n")]
    df = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).repartition(2)
    rows = pack_documents(df, vocabulary()).collect()
    assert check(rows, docs) <= 2
    assert check(pack_documents(df, vocabulary(), pool_tokens=3000).collect(), docs) <= 40


def test_step_groups_hold_equal_tokens(spark):
    docs = [(i, "word " * (37 * i % 900)) for i in range(120)]
    rows = pack_documents(spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).coalesce(1), vocabulary(), step_tokens=4096).collect()
    group = defaultdict(int)
    for r in rows:
        group[r.tier, r.step_group] += r.length
    last = {t: max(g for x, g in group if x == t) for t, _ in group}
    assert all(n == 4096 for (t, g), n in group.items() if g < last[t])


def test_step_groups_are_a_partitions_own(spark):
    docs = [(i, "word " * (37 * i % 900)) for i in range(240)]
    rows = pack_documents(spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).repartition(4), vocabulary(), step_tokens=4096).collect()
    group, parts = defaultdict(int), defaultdict(set)
    for r in rows:
        group[r.tier, r.step_group] += r.length
        parts[r.tier, r.step_group].add(r.sequence_id >> 36)
    assert all(len(p) == 1 for p in parts.values()) and len(set().union(*parts.values())) == 4
    short = defaultdict(int)
    for (t, g), n in group.items():
        assert n <= 4096
        short[t, g >> 36] += n < 4096
    assert max(short.values()) <= 1


def test_long_runs(spark):
    """Runs beyond what regular expressions take at once."""
    docs = [(1, " " * 1_000_000 + "a"), (2, "\n" * 1_000_000), (3, "ab" * 500_000), (4, "a" + " \n" * 300_000 + "b"), (5, "-" * 200_000), (6, "é" * 100_000 + "\t" * 5000)]
    assert check(pack_documents(spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).repartition(3), vocabulary()).collect(), docs) <= 3


def test_empty_and_nulls(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), vocabulary()).collect() == []
    rows = pack_documents(spark.createDataFrame([(None, "a b", "x"), (5, None, None), (5, None, None)], SCHEMA).coalesce(1), vocabulary()).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 1), (False, 1), (True, 3)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    import __spark_entry__

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = __spark_entry__.queries()["op7_packing"](spark, f"/root/testdata/{sf}").collect()
    assert check(rows, [tuple(d) for d in docs]) <= 1


def test_encoder_agrees_with_the_tokenizer():
    from larkspur.llm.packing import Encoder

    encode, rng = Encoder(vocabulary()), np.random.RandomState(3)
    plain = [chr(c) for c in range(1, 0x3100) if encode.plain(chr(c))]
    texts = ["a" + c + " " + c + "1" + c + "'s" for c in plain]
    texts += ["".join(rng.choice(plain, 300)) for _ in range(300)]
    texts += ["".join(rng.choice(list("ab 1'st\n\t .é"), 80)) for _ in range(2000)]
    for text in texts:
        assert encode.plain(text)
        assert encode(text) == encode.exact(text).astype("<u4").tobytes(), repr(text)
