"""Line dedup: fuzzy copies of lines found by MinHash, one line kept of each component.

Lines are normalised (A-Z lower-cased, one space between words); blank ones take no part. A line's set is its runs of `k`
characters. A signature has `bands` times `rows` minima, and a band's key is a hash of its own: lines of the threshold's likeness miss
all bands about twice in a thousand, those above it hardly ever, and with seven rows unlike lines of one language share next to none
as the corpus grows. Minima are drawn by rounds: a round deals all shingles to the slots by one hash, later rounds only
matter to lines with slots still empty, and what a few rounds leave empty takes a minimum of its own. So a long line costs one hash a shingle,
and any two lines agree in a slot with their Jaccard index as probability. Pairs in a block are compared by the Jaccard index of their
sets, and union-find joins the links. Of each component the line of the least (doc_id, line) stays.

A line's text is shuffled once, to chunks by its digest, after each task has dropped its own copies. Each chunk sketches its lines'
bands (the merged count-min sketch of `substring`) and says where each cell's bands are; the merged sketch answers with the bands whose cells
another line has too, and only lines with such a band are signed again and go on. The occurrences
of a common line are narrow rows, whose least is aggregated before the shuffle and joined back.

A document is its id and text. Nulls: a null text has no lines; a null id comes last in order. Rows that repeat id and text keep and lose the
same lines; rows that repeat an id with other texts are documents each. Very long lines and texts are compared whole, in one
task's memory. An empty table gives no rows. `dedup_lines` keeps extra columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import open_blocks, pairs_to_test, search_blocks, small_pairs, star_pairs, with_least
from .graph import components
from .store import saved
from .substring import Sketch, cells_twice, pack_bits, pack_cells, unpack_bits
from .text import buffers, mix, reuse_memory, signed, slices

_U = np.uint64
_LATE = np.iinfo(np.int64).max
_NONE = np.iinfo(np.uint32).max
_A = np.random.RandomState(77).randint(0, 2**31, 4096).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = 0x9E3779B97F4A7C15
#: Rounds that deal shingles to slots before the slots left take their own minima, and lines that are signed at a time.
ROUNDS, LINES = 24, 400
#: Bytes of texts that are looked through at once for blanks, about; a longer text by itself is not looked through.
TIDY = 1 << 17
#: Characters of a shingle: one changed character within a line of 49 still links it at the threshold.
PROSE = 5
#: Groups whose counts bound two lines' overlap.
GROUPS = 512
#: Numbers of lines (8 bytes each) that are broadcast at most, to shuffle only the texts that pairs need.
BROADCAST_IDS = 200_000
digest = xxhash.xxh3_128_digest
#: What `line_components` writes down of a line.
GIVEN = {"id": pa.binary(), "num": pa.int64(), "text": pa.string(), "keys": pa.list_(pa.int64()), "doc": pa.int64(), "line": pa.int32(), "th": pa.int64(), "n": pa.int64()}


def normal_lines(text: str | None) -> list[tuple[int, bytes]]:
    """(number, normalised line) of the lines that have a word."""
    return own_lines((text or "").encode().lower())


def own_lines(data: bytes) -> list[tuple[int, bytes]]:
    plain = not any(x in data for x in (b"  ", b"\t", b"\r", b"\x0b", b"\x0c"))
    bare = (x.strip() if plain else b" ".join(x.split()) for x in data.split(b"\n"))
    return [(i, x) for i, x in enumerate(bare) if x]


def tidy_texts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts have no blanks but line ends and single spaces between two words of a line; some that have none may be left out."""
    if len(data) > 8 * TIDY:
        return np.zeros(len(bounds) - 1, bool)
    space, end = data == 32, data == 10
    odd = (data - np.uint8(9) <= 4) & ~end
    odd[1:] |= space[1:] & (space | end)[:-1]
    odd[:-1] |= space[:-1] & end[1:]
    some = np.flatnonzero(np.diff(bounds))
    edges = np.concatenate([bounds[some], bounds[some + 1] - 1])
    odd[edges] |= space[edges]
    out = np.ones(len(bounds) - 1, bool)
    out[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = False
    return out


def column_lines(texts: pa.Array) -> Iterator[list[tuple[int, bytes]]]:
    """normal_lines of each text; a tidy one only needs to be cut at its line ends."""
    data, bounds = buffers(texts)
    for _, _, part, edges in slices(data, bounds, TIDY):
        for tidy, lo, hi in zip(tidy_texts(part, edges).tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = part[lo:hi].tobytes().lower()
            yield [(i, x) for i, x in enumerate(own.split(b"\n")) if x] if tidy else own_lines(own)


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k values in a row, by doubling."""
    base, out, have, h, n = 0xD1342543DE82EF95, None, 0, points, 1
    while n <= k:
        if k & n:  # what there is so far, then the next n
            out = h if out is None else out[: len(out) - n] * _U(pow(base, n, 1 << 64)) + h[have : have + len(out) - n]
            have += n
        if 2 * n <= k:
            h = h[:-n] * _U(pow(base, n, 1 << 64)) + h[n:]
        n *= 2
    return out


def shingle_hashes(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all lines' shingles and where each line's begin; a shorter line is one shingle."""
    n = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer(("".join(lines) + "\0" * k).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    own = np.maximum(n - (k - 1), 1)
    first, start = np.cumsum(own) - own, np.cumsum(n) - n
    h = mix(rolling(points, k))[np.repeat(start - first, own) + np.arange(own.sum())]
    for i in np.flatnonzero(n < k).tolist():
        h[first[i]] = xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass"))
    return h, np.append(first, own.sum())


def places(first: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Where the elements of runs `which` are, one run after another."""
    own = size[which]
    start = np.cumsum(own) - own
    return np.repeat(first[which] - start, own) + np.arange(own.sum())


def scatter(x: np.ndarray, r) -> np.ndarray:
    """Another 32-bit hash of hashes for each r."""
    x = x * _A[r]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x


def minima(h: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """(line, slot): a minimum over each line's shingles. Of an earlier round is less than of a later one."""
    size, n, h = np.diff(first), len(first) - 1, (h >> _U(32)).astype(np.uint32)
    out = np.full((n, slots), _NONE, np.uint32)
    flat, open_, own, base = out.reshape(-1), np.arange(n), h, np.repeat(np.arange(n) * slots, size)
    low, high, wide = np.uint32(0xFFFFFF), np.uint32(16), np.uint32(slots)

    for r in range(ROUNDS):
        x = scatter(own, r)
        slot = x >> high
        slot *= wide
        slot >>= high
        x &= low
        x |= np.uint32(r << 24)
        np.minimum.at(flat, base + slot, x)
        if r < 8 or r % 4 == 3:
            left = open_[(out[open_] == _NONE).any(1)]
            if not len(left):
                return out
            if size[left].sum() < 0.75 * len(own):  # else what is full goes along
                open_ = left
                own, base = h[places(first, size, open_)], np.repeat(open_ * slots, size[open_])
    line, slot = np.nonzero(out == _NONE)
    for lo in range(0, len(line), 1024):
        at, to = line[lo : lo + 1024], slot[lo : lo + 1024]
        x = scatter(h[places(first, size, at)], np.repeat(to + ROUNDS, size[at]))
        out[at, to] = np.uint32(ROUNDS << 24) | (np.minimum.reduceat(x, np.cumsum(size[at]) - size[at]) >> np.uint32(8))
    return out


def band_keys(lines: list[str], k: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of all lines' bands."""
    h, first = shingle_hashes(lines, k)
    parts = minima(h, first, bands * rows).astype(_U).reshape(len(lines), bands, rows)
    x = np.full((len(lines), bands), _U(1), _U) + np.arange(bands, dtype=_U) * _U(_STEP)
    for r in range(rows):
        x = mix(x ^ parts[:, :, r])
    return np.repeat(np.arange(len(lines)), bands), x.ravel()


def by_length(texts: list[str]) -> list[np.ndarray]:
    """Places of texts, like lengths together: at most LINES, of few characters unless one text is longer."""
    size = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(size, kind="stable")
    block = np.cumsum(size[order]) // (LINES * 400) * len(texts) + np.arange(len(texts)) // LINES
    return np.split(order, np.flatnonzero(np.diff(block)) + 1) if texts else []


def known_docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc (never null), th (a hash of the text) and text."""
    own = F.col(id_col).cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(_LATE)).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def place(doc: Column, line: Column, th: Column) -> Column:
    """The order of occurrences as one number, which aggregates by hash: document, line, and some bits of the text's hash."""
    whole = lambda x: x.cast("decimal(38,0)")
    high = (whole(doc) * F.lit(2**62).cast("decimal(19,0)")).cast("decimal(38,0)")
    return (high + whole(F.shiftleft(line.cast("long"), 31).bitwiseOR(F.shiftrightunsigned(th, 33)))).cast("decimal(38,0)")


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc and th of each document, line and id (the digest) of each of its lines that have a word, and its characters."""

    def run(batches):
        for b in batches:
            line, ids, cuts = [], [], [0]
            for own in column_lines(b.column(3)):
                for i, x in own:
                    line.append(i)
                    ids.append(digest(x))
                cuts.append(len(line))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x) for x in (pa.array(line, pa.int32()), pa.array(ids, pa.binary()))]
            yield pa.record_batch([*b.columns[:3], *lists, pc.utf8_length(b.column(3)).cast(pa.int64())], names=["doc_id", "doc", "th", "lines", "ids", "chars"])

    return known_docs(docs, id_col, text_col).mapInArrow(run, "doc_id long, doc long, th long, lines array<int>, ids array<binary>, chars long")


def distinct_lines(docs: DataFrame, chunks: int, id_col: str, text_col: str, most: int = 8_000_000) -> DataFrame:
    """chunk, id, text, doc, line, th, n of the lines; a task gives each of its lines once in about `most` characters, with the least
    (doc, line, th) that has it and how many have."""

    def run(batches):
        seen: dict = {}  # digest: [text, (doc, line, th), n]
        held = 0

        def table():
            ids, rows = list(seen), list(seen.values())
            numbers = [int.from_bytes(i[:8], "little") % chunks for i in ids]
            column = lambda k, t: pa.array([r[1][k] for r in rows], t)
            return pa.record_batch([pa.array(numbers, pa.int64()), pa.array(ids, pa.binary()), pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()), column(0, pa.int64()), column(1, pa.int32()), column(2, pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["chunk", "id", "text", "doc", "line", "th", "n"])

        for b in batches:
            for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), column_lines(b.column(2)), strict=True):
                for i, x in t:
                    if (have := seen.get(own := digest(x))) is None:
                        seen[own] = [x, (d, i, h), 1]
                        held += len(x)
                    else:
                        have[2] += 1
                        have[1] = min(have[1], (d, i, h))
                if held > most:
                    yield table()
                    seen.clear()
                    held = 0
        yield table()

    own = known_docs(docs, id_col, text_col).select("doc", F.shiftrightunsigned("th", 33).alias("th"), "text")
    return own.mapInArrow(run, "chunk long, id binary, text string, doc long, line int, th long, n long")


def distinct_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct shingles each text has, where they begin, and their hashes (54 bits, fewer beyond 1023 texts), sorted text by text."""
    h, first = shingle_hashes(texts, k)
    bits = _U(max(10, len(texts).bit_length()))
    own = np.sort(np.repeat(np.arange(len(texts), dtype=_U), np.diff(first)) << (_U(64) - bits) | h >> bits)
    own = own[np.diff(own, prepend=own[0] ^ _U(1)) != 0]
    size = np.bincount((own >> (_U(64) - bits)).astype(np.int64), minlength=len(texts))
    return size, np.cumsum(size) - size, own & ((_U(1) << (_U(64) - bits)) - _U(1))


def jaccard_links(texts: list[str], x: np.ndarray, y: np.ndarray, k: int, num: int, den: int) -> np.ndarray:
    """Which of at most 1024 pairs (x, y) of places in texts link: first by sizes, then by counts of shingles in GROUPS groups, then by their sets."""
    size, first, own = distinct_shingles(texts, k)
    line = np.repeat(np.arange(len(texts)), size)
    points = np.bincount(line * GROUPS + (own % _U(GROUPS)).astype(np.int64), minlength=len(texts) * GROUPS).reshape(-1, GROUPS).astype(np.int32)
    need = -(-num * (size[x] + size[y]) // (den + num))
    at = np.flatnonzero((size[x] >= need) & (size[y] >= need))
    at = at[np.minimum(points[x[at]], points[y[at]]).sum(1) >= need[at]]
    pair = np.arange(len(at), dtype=_U) << _U(54)
    both = np.concatenate([np.repeat(pair, size[z[at]]) | own[places(first, size, z[at])] for z in (x, y)])
    both.sort(kind="stable")  # two sorted runs, which it merges
    overlap = np.bincount((both[1:][both[1:] == both[:-1]] >> _U(54)).astype(np.int64), minlength=len(at))
    out = np.zeros(len(x), bool)
    out[at] = overlap >= need[at]
    return out


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    num, den = threshold

    def compare(batches):
        reuse_memory()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                own: dict = {}
                x, y = (np.array([own.setdefault(i, (len(own), t))[0] for i, t in zip(b.column(c).to_pylist(), b.column(c + 2).to_pylist(), strict=True)]) for c in (0, 1))
                keep = jaccard_links([t for _, t in own.values()], x, y, k, num, den)
                yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    near, far = texts.select(F.col("num").alias("_a"), F.col("text").alias("ta")), texts.select(F.col("num").alias("_b"), F.col("text").alias("tb"))
    return pairs.join(near, F.col("a") == F.col("_a")).join(far, F.col("b") == F.col("_b")).select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def labels(links: DataFrame) -> DataFrame:
    """id and component: the least that an id links with, or that this does; enough for `open_blocks` to leave out most of what is joined."""
    one = links.groupBy("a").agg(F.min("b").alias("b"))
    two = one.select(F.col("a").alias("_b"), F.col("b").alias("c"))
    return one.join(two, F.col("b") == F.col("_b"), "left").select(F.col("a").alias("id"), F.coalesce("c", "b").alias("component"))


def needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts, without those that are not among ids where these are few."""
    return texts.join(F.broadcast(ids), F.col("num") == F.col("id"), "left_semi") if ids.count() <= BROADCAST_IDS else texts


def cross_links(group: pa.Table, k: int, num: int, den: int) -> tuple[list, list]:
    """Links between components within a group of `blocks`, as few as join what links; texts and keys are columns of the group.

    A pair that shares a lesser key is left to that block, and only lines with a pair that is left are parted into shingles.
    """
    block, lists = group.column("key")[0].as_py(), group.column("keys").combine_chunks()
    cuts = lists.offsets.to_numpy()
    names, number = np.unique(lists.values.to_numpy()[cuts[0] : cuts[-1]], return_inverse=True)
    cuts, less, met = cuts - cuts[0], names < block, np.zeros(len(names), bool)  # every list holds the block's key
    pairs: list[tuple[int, np.ndarray]] = []
    for x, ys in pairs_to_test(group):
        own = number[cuts[x] : cuts[x + 1]]
        own = own[less[own]]
        if len(own) and len(ys):
            met[own] = True
            ys = ys[~np.logical_or.reduceat(met[number], cuts[:-1])[ys]]
            met[own] = False
        if len(ys):
            pairs.append((x, ys))
    if not pairs:
        return [], []
    used = np.unique(np.concatenate([np.append(ys, x) for x, ys in pairs]))
    texts = group.column("text").take(pa.array(used)).to_pylist()
    size, start, own = distinct_shingles(texts, k)
    _, flat = np.unique(own, return_inverse=True)
    mark, ids = np.zeros(flat.max() + 1, bool), group.column("id").to_numpy()[used]
    _, of = np.unique(group.column("component").to_numpy(), return_inverse=True)
    root, of, a, b = np.arange(of.max() + 1), of[used], [], []
    for x, ys in pairs:
        x, ys = int(np.searchsorted(used, x)), np.searchsorted(used, ys)
        ys = ys[(root[of[ys]] != root[of[x]]) & (den * size[ys] >= num * size[x]) & (den * size[x] >= num * size[ys])]
        if not len(ys):
            continue
        mark[flat[start[x] : start[x] + size[x]]] = True
        both = np.add.reduceat(mark[flat[places(start, size, ys)]], np.cumsum(size[ys]) - size[ys], dtype=np.int64)
        mark[flat[start[x] : start[x] + size[x]]] = False
        for y in ys[den * both >= num * (size[x] + size[ys] - both)].tolist():
            p, q = root[of[x]], root[of[y]]
            if p != q:
                root[root == p] = q
                a.append(int(ids[x]))
                b.append(int(ids[y]))
    return a, b


def small_links(rows: pa.Table, first: np.ndarray, size: np.ndarray, k: int, num: int, den: int) -> tuple[list, list]:
    """The links of many small groups of `blocks` by the same rules: pairs that share a lesser key are left out, a pair is compared once."""
    x, y = small_pairs(rows, first, size)
    ids, at, of = np.unique(rows.column("id").to_numpy(), return_index=True, return_inverse=True)
    lists = rows.column("keys").combine_chunks()
    cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    number = np.unique(np.append(values[cuts[0] : cuts[-1]], rows.column("key").to_numpy()), return_inverse=True)[1]
    keys, key, cuts = number[: cuts[-1] - cuts[0]], number[cuts[-1] - cuts[0] :], cuts - cuts[0]
    less = []
    for z in (x, y):
        own = keys[places(cuts[:-1], np.diff(cuts), z)]
        pair = np.repeat(np.arange(len(z)), np.diff(cuts)[z])
        lesser = own < key[x][pair]
        less.append(np.unique(pair[lesser] * len(number) + own[lesser]))
    both = np.sort(np.concatenate(less), kind="stable")
    left = np.ones(len(x), bool)
    left[both[1:][both[1:] == both[:-1]] // max(1, len(number))] = False
    pairs = np.unique(np.minimum(of[x], of[y])[left] * len(ids) + np.maximum(of[x], of[y])[left])
    a, b = pairs // max(1, len(ids)), pairs % max(1, len(ids))
    texts, keep = rows.column("text").take(pa.array(at)).to_pylist(), np.zeros(len(pairs), bool)
    for lo in range(0, len(pairs), 512):
        used, which = np.unique(np.concatenate([a[lo : lo + 512], b[lo : lo + 512]]), return_inverse=True)
        keep[lo : lo + 512] = jaccard_links([texts[i] for i in used.tolist()], *which.reshape(2, -1), k, num, den)
    return ids[a[keep]].tolist(), ids[b[keep]].tolist()


def numbered_lines(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct lines of a chunk, numbered by digest, so that every pass numbers alike: which each row has, and a row of each."""
    coded = group.column("id").combine_chunks().dictionary_encode()
    rank = np.argsort(pc.sort_indices(coded.dictionary).to_numpy())
    of, row = rank[coded.indices.to_numpy()], np.zeros(len(rank), np.int64)
    row[of[::-1]] = np.arange(len(of))[::-1]
    return of, row


def line_components(docs: DataFrame, total: int, *, k: int, bands: int, rows: int, threshold: tuple[int, int], chunk_chars: int, most: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """total: the characters of all texts. Two tables: id (the digest), num, at (the first place that has it) and n of the lines that are there twice or may be alike to
    another; and id and component, the least num in it, of those that are alike to another but for the least."""
    num, den = threshold
    chunks, shape = max(1, -(-total // chunk_chars)), Sketch(max(1, total * bands // 250), 1, 4096)
    lines = distinct_lines(docs, chunks, id_col, text_col)

    def signed_lines(group, row):
        """The bands' keys of the lines that are in these rows."""
        texts, keys = group.column("text").take(pa.array(row)).to_pylist(), np.zeros((len(row), bands), _U)
        for which in by_length(texts):
            keys[which] = band_keys([texts[i] for i in which], k, bands, rows)[1].reshape(-1, bands)
        return keys

    def sketch(key, group):
        reuse_memory()
        _, row = numbered_lines(group)
        keys, out = signed_lines(group, row).ravel(), []
        width = len(keys).bit_length()
        for number, cell, at, order in shape.sorted_cells(keys):
            new = np.diff(cell, prepend=-1) != 0
            first, at = np.flatnonzero(new), at[order]
            several = np.minimum.reduceat(at // bands, first) != np.maximum.reduceat(at // bands, first)
            out.append((number, pack_cells(cell[first], several, shape.size), len(at), np.packbits(new).tobytes() + pack_bits(at, width)))
        column = lambda c, t: pa.array([x[c] for x in out], t)
        return pa.table({"segment": column(0, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()), "cells": column(1, pa.binary()), "width": pa.array([width] * len(out), pa.int32()), "n": column(2, pa.int64()), "places": column(3, pa.binary())})

    def merge(key, group):
        reuse_memory()
        out = []
        for twice, width, n, data in zip(cells_twice(group.column("cells"), shape), *(group.column(c).to_pylist() for c in ("width", "n", "places")), strict=True):
            raw = np.frombuffer(data, np.uint8)
            new = np.unpackbits(raw[: (n + 7) // 8], count=n)
            out.append(unpack_bits(raw[(n + 7) // 8 :], n, width)[twice[np.cumsum(new, dtype=np.int64) - 1]].tobytes())
        return pa.table({"chunk": group.column("chunk"), "marks": pa.array(out, pa.binary())})

    def give(key, group, marks):
        if not group.num_rows:
            return pa.table({n: pa.array([], t) for n, t in GIVEN.items()})
        reuse_memory()
        of, row = numbered_lines(group)
        twice = np.sort(np.frombuffer(b"".join(marks.column("marks").to_pylist()), np.int64))
        shared = np.bincount(twice // bands, minlength=len(row))
        signed_ = np.flatnonzero(shared)
        keys = signed_lines(group, row[signed_])[np.repeat(np.arange(len(signed_)), shared[signed_]), twice % bands]
        column = lambda c: group.column(c).to_numpy()
        order = np.lexsort((column("th"), column("line"), column("doc"), of))  # a line's least place first
        least, n = order[np.searchsorted(of[order], np.arange(len(row)))], np.bincount(of, column("n"), len(row)).astype(np.int64)
        out = np.flatnonzero((shared > 0) | (n > 1))
        cuts = pa.array(np.append(0, np.cumsum(shared[out])).astype(np.int32))
        number = (key[0].as_py() << 32) + out
        text = group.column("text").take(pa.array(row[out], mask=shared[out] == 0))
        lists = pa.ListArray.from_arrays(cuts, pa.array(signed(keys)))
        first = group.select(["doc", "line", "th"]).take(pa.array(least[out]))
        return pa.table([group.column("id").take(pa.array(row[out])), pa.array(number), text, lists, *first.columns, pa.array(n[out])], names=list(GIVEN))

    sketches = lines.groupBy("chunk").applyInArrow(sketch, "segment long, chunk long, cells binary, width int, n long, places binary")
    marks = sketches.groupBy("segment").applyInArrow(merge, "chunk long, marks binary")
    likely = saved(lines.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(give, "id binary, num long, text string, keys array<long>, doc long, line int, th long, n long"), "lines")
    firsts = likely.select("id", "num", place(F.col("doc"), F.col("line"), F.shiftleft("th", 33)).alias("at"), "n")
    likely = likely.where(F.size("keys") > 0).select("num", "text", "keys")
    in_block = likely.select(F.explode("keys").alias("key"), F.col("num").alias("id"))

    others = saved(with_least(in_block), "blocks")
    links = saved(verify(star_pairs(others), likely, k, threshold), "found")
    open_ = saved(open_blocks(others, labels(links), most), "open")
    texts = needed(likely, open_.select("id").distinct()).select("num", "text", "keys")
    more = search_blocks(open_.join(texts, F.col("id") == F.col("num")), lambda group: cross_links(group, k, num, den), "a long, b long", lambda *groups: small_links(*groups, k, num, den))
    return firsts, components(links.unionAll(more))


def duplicate_lines(docs: DataFrame, *, k: int = PROSE, bands: int = 26, rows: int = 7, threshold: tuple[int, int] = (80, 100), chunk_chars: int = 8_000_000, most: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc and th (what names the document: see `known_docs`), n_lines (with a word) and removed (numbers of lines that go) of
    each row."""
    rows_ = saved(occurrences(docs, id_col, text_col), "occurrences")
    total = rows_.agg(F.sum("chars")).first()[0] or 0
    firsts, of = line_components(docs, total, k=k, bands=bands, rows=rows, threshold=threshold, chunk_chars=chunk_chars, most=most, id_col=id_col, text_col=text_col)
    of = of.unionAll(of.select("component", "component").distinct())  # and the least of each
    of = of.select(F.col("id").alias("_id"), "component")
    told = firsts.join(of, firsts.num == of["_id"], "left").where(F.col("component").isNotNull() | (F.col("n") > 1)).select("id", F.coalesce("component", "num").alias("component"), "at")
    best = told.groupBy("component").agg(F.min("at").alias("kept")).withColumnRenamed("component", "_c")
    stays = told.join(best, told.component == best["_c"]).select(F.col("id").alias("_id"), "kept")
    each = rows_.select("doc", "th", F.explode(F.arrays_zip("lines", "ids")).alias("x")).select("doc", "th", F.col("x.lines").alias("line"), F.col("x.ids").alias("id"))
    gone = each.join(stays, each.id == stays["_id"]).where(place(F.col("doc"), F.col("line"), F.col("th")) != F.col("kept"))  # lines that are alone stay
    removed = gone.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.sort_array(F.collect_set("line")).alias("removed"))
    out = rows_.select("doc_id", "doc", "th", F.size("lines").alias("n_lines")).join(removed, (F.col("doc") == F.col("_doc")) & (F.col("th") == F.col("_th")), "left")
    return out.select("doc_id", "doc", "th", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with n_lines and n_removed, their text without the removed lines. Columns of these names are replaced."""
    docs = docs.drop(*({"n_lines", "n_removed"} - {id_col, text_col}))
    told = duplicate_lines(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias("__ls_doc"), F.col("th").alias("__ls_th"), F.col("n_lines").alias("__ls_n"), F.col("removed").alias("__ls_removed"))
    told = told.where(F.col("__ls_n") > 0).distinct()  # rows that repeat id and text have the same lines
    named = (F.coalesce(docs[id_col].cast("long"), F.lit(_LATE)) == told["__ls_doc"]) & (F.xxhash64(docs[text_col]) == told["__ls_th"])
    joined = docs.join(told, named, "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__ls_removed", i)), "\n")
    text = F.when(F.size("__ls_removed") > 0, left).otherwise(F.col(text_col))
    others = [F.col(c) if c != text_col else text.alias(c) for c in docs.columns]
    return joined.select(*others, F.coalesce("__ls_n", F.lit(0)).alias("n_lines"), F.coalesce(F.size("__ls_removed"), F.lit(0)).alias("n_removed"))
