"""The passes of `lines` over a chunk, and small groups of blocks beside the search of one group."""

import numpy as np
import pyarrow as pa
from larkspur.llm import lines as L
from larkspur.llm import substring


def test_only_lines_that_may_be_alike_are_signed_twice(spark, tmp_path, monkeypatch):
    rng, signed, plain = np.random.RandomState(3), tmp_path / "signed", L.band_keys
    texts = ["\n".join(" ".join(f"w{x}" for x in rng.randint(0, 10**6, 12)) for _ in range(20)) for _ in range(30)]
    texts.append(texts[4].split("\n")[7].replace("w", "v", 1))

    def counted(lines, *more):
        with signed.open("a") as f:
            f.write(f"{len(lines)}\n")
        return plain(lines, *more)

    monkeypatch.setattr(L, "band_keys", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.removed for r in L.duplicate_lines(docs, chunk_chars=10_000).collect()}
    assert got == {**dict.fromkeys(range(30), []), 30: [0]}
    assert 601 <= sum(map(int, signed.read_text().split())) < 650


def test_tidy_texts_are_only_cut(monkeypatch):
    rng, cut, plain = np.random.RandomState(9), [], L.own_lines
    monkeypatch.setattr(L, "own_lines", lambda data: cut.append(data) or plain(data))
    tidy = ["One two\n\nTHREE\n", "", "é ß", None, "a\nb c"]
    assert list(L.column_lines(pa.array(tidy))) == [[(0, b"one two"), (2, b"three")], [], [(0, "é ß".encode())], [], [(0, b"a"), (1, b"b c")]] and not cut
    for untidy in ("a  b", " a", "a ", "a \nb", "a\n b", "a\tb", "a\r\nb", "a\x0bb", "a\x0c"):
        assert list(L.column_lines(pa.array(["x y", untidy, "z"]))) == [[(0, b"x y")], plain(untidy.encode()), [(0, b"z")]] and cut.pop() == untidy.encode() and not cut
    for most in (4, 64, 1 << 17):
        monkeypatch.setattr(L, "TIDY", most)
        texts = [None if n < 2 else "".join(rng.choice(list("aB  \n\t\r\x0b\x0c\x08\x0e\x1fé"), n)) for n in rng.randint(0, 80, 400)]
        assert list(L.column_lines(pa.array(texts, pa.string()).slice(3))) == [L.normal_lines(t) for t in texts[3:]]


def test_bits_come_back():
    rng = np.random.RandomState(5)
    for width in (0, 1, 7, 8, 20, 33, 62):
        for n in (0, 1, 13, 500):
            x = rng.randint(0, 2**62, n) % (1 << width)
            assert (substring.unpack_bits(np.frombuffer(substring.pack_bits(x, width), np.uint8), n, width) == x).all()


def roots(links, n):
    root = np.arange(n)
    for p, q in links:
        root[root == root[p]] = root[q]
    return [np.flatnonzero(root == root[i])[0] for i in range(n)]


def test_small_groups_give_what_each_gives_alone():
    rng = np.random.RandomState(8)
    word = lambda: "".join(map(chr, rng.randint(97, 123, 6)))
    base = [" ".join(word() for _ in range(12)) for _ in range(8)]
    texts = [b[:-1] + chr(97 + i) for b in base for i in range(5)]
    keys = [sorted({*rng.randint(0, 30, 3).tolist(), 100 + n // 5, 200 + n // 10}) for n in range(len(texts))]
    rows, first = [], []
    for key in sorted({k for own in keys for k in own}):
        ids = [n for n, own in enumerate(keys) if key in own]
        if 2 <= len(ids) <= 16:
            first.append(len(rows))
            kind = int(key % 7 == 0)
            rows += [(key, kind, 0, kind, n, n, bool(kind) or n % 3 > 0, n % 2 if kind else 0, texts[n], keys[n]) for n in ids]
    names = ["key", "kind", "i", "j", "id", "component", "minor", "part", "text", "keys"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.int64())]
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    size = np.diff([*first, len(rows)])
    alone = [L.cross_links(table.slice(lo, n), 5, 80, 100) for lo, n in zip(first, size.tolist(), strict=True)]
    one = [p for a, b in alone for p in zip(a, b, strict=True)]
    many = list(zip(*L.small_links(table, np.array(first), size, 5, 80, 100), strict=True))
    assert one and roots(one, len(texts)) == roots(many, len(texts))
    assert {n // 5 for p in many for n in p} and all(p // 5 == q // 5 for p, q in many)
    none = L.small_links(table, np.array(first[:1]), np.array([1]), 5, 80, 100)
    assert none == ([], [])
