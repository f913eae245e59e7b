"""N-gram Jaccard join: which documents' sets of word shingles are alike, exactly, and the components of those links.

A document's shingles are hashed to groups. The counts in `GROUPS` groups make it a point, and the summed minima of two
points' coordinates bound their overlap from above; an R-tree's node bounds it for all its points by its upper corner.

A single tree cannot be spread over tasks, since in so many dimensions every large node's box meets every query.
So groups also route documents to small blocks: sizes fall in classes of ratio `1 / threshold`, and two sets that link
differ in at most k elements, k known for a class. With elements in more than k groups, some group is the same in both; its
content is a block's key, and with a few more, linked sets share several keys. There are as many groups as leave sets of the class
enough of them that are not empty, so that sets with nothing in common meet nowhere. Blocks lose no link: a set with too many
empty groups, which is about one in millions, gives the empty ones too.

1. Documents are dealt to chunks of bounded size. Each chunk sketches its keys (see `substring`: a merged count-min
   sketch finds those used in several places); documents with such a key give their set, point and keys.
2. Equal sets collapse to the one of least id. In each block, members meet the least, pairs pass the bound of their
   points, and their sets are compared. Blocks that still hold several components are searched by an R-tree for pairs
   across them, and these are compared in the same way.

Nulls: a null text has no shingles and links with nothing; rows that repeat an id are one node, and so are
rows with a null id, the last in order: their component is the least id they reach, null if there is none. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import open_blocks, pairs_to_test, search_blocks, star_pairs, with_least
from .chunks import total_chars, with_chunks
from .graph import components
from .store import saved
from .substring import Sketch, merge_sketches, pack_cells, repeated
from .text import Words, buffers, lower, mix, run_hashes, signed, slices

_U = np.uint64
_LATE = np.iinfo(np.int64).max
#: Coordinates of a point, at least, and elements to a coordinate of larger sets: with fewer, unlike large sets have like counts.
GROUPS, FILL = 256, 8
#: Ids of pairs (8 bytes each) that are broadcast at most; beyond, all sets are shuffled.
BROADCAST_IDS = 200_000
#: Linked sets have at least SHARED keys in common; standard deviations by which groups that are not empty may be fewer than expected.
SHARED, SPARE = 3, 5.0


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words is one shingle."""
    out: list[np.ndarray] = []
    data, bounds = buffers(texts)
    for lo, hi, part, edges in slices(data, bounds):
        words = Words(lower(part), edges)
        own = np.where(words.counts >= width, words.counts - (width - 1), np.minimum(words.counts, 1))
        of = np.repeat(np.arange(hi - lo), own)
        ends = np.cumsum(own)
        begin = words.firsts[:-1][of] + np.arange(len(of)) - np.repeat(ends - own, own)
        h = run_hashes(words.hashes(), begin, begin + np.minimum(width, words.counts[of]), 0xA24BAED4963EE407)
        out += [np.unique(h[e - n : e]) for e, n in zip(ends.tolist(), own.tolist(), strict=True)]
    return out


class Classes:
    """Classes of set sizes, and how many elements two linked sets may differ in. A link: den * overlap >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.lows, self.dealt = num, den, [1], {}

    def of(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(self.den * self.lows[-1] // self.num + 1)
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def differ(self, c: int) -> int:
        """The most elements in one but not both of two linked sets, the smaller of class c."""
        top = self.den * self.lows[c] // self.num
        return (top + self.den * top // self.num) * (self.den - self.num) // (self.den + self.num)

    def groups(self, c: int) -> tuple[int, int]:
        """How many groups sets of class c are hashed to, and how many of two linked sets' groups are the same and not empty at least.

        The least number of groups with which a set of the class's least size fills enough but for SPARE standard deviations.
        """
        if c not in self.dealt:
            n, k = self.lows[c], self.differ(c)
            for shared in range(SHARED, 0, -1):
                m = k + shared
                while m < 64 * n and self.filled(n, m) < k + shared:
                    m += 1 + m // 200
                self.dealt[c] = m, shared
                if m < 64 * n:
                    break
        return self.dealt[c]

    @staticmethod
    def filled(n: int, m: int) -> float:
        """Groups of m that n elements fill, at least but for SPARE standard deviations."""
        empty, two = m * (1 - 1 / m) ** n, m * (m - 1) * (1 - 2 / m) ** n if m > 1 else 0.0
        return m - empty - SPARE * max(0.0, two + empty - empty * empty) ** 0.5

    def need(self, a, b):
        """The least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.den + self.num))


def block_keys(s: np.ndarray, classes: Classes) -> np.ndarray:
    """The keys of a set's groups, in the scheme of its own class and of the class below."""
    out, c = [], classes.of(len(s)) if len(s) else -1
    place, content = mix(s ^ _U(0x1B03738712FAD5C9)), mix(s ^ _U(0x8BB84B93962EACC9))
    for scheme in (c, c - 1):
        if scheme < 0 or not (k := classes.differ(scheme)):
            continue  # sets that may not differ are equal, and equal sets are one
        m, shared = classes.groups(scheme)
        group = (place % _U(m)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
        full = group[order][cuts]
        sums, size = np.add.reduceat(content[order], cuts), np.diff(cuts, append=len(s))
        salt = _U(scheme) << _U(32)
        keys = mix(sums ^ mix(full.astype(_U) + salt)) + size.astype(_U)
        if len(full) < k + shared:
            keys = np.append(keys, mix(mix(np.setdiff1d(np.arange(m), full).astype(_U) + salt)))
        out += [keys, *(mix(keys + _U(r)) for r in range(1, -(-SHARED // shared)))]  # as many keys in common as SHARED
    return np.concatenate(out) if out else np.zeros(0, _U)


def point(s: np.ndarray, groups: int | None = None) -> np.ndarray:
    """Counts of a set's elements by group; the number of groups is a power of two that follows the size, unless it is given."""
    groups = groups or max(GROUPS, 1 << max(0, len(s) // FILL - 1).bit_length())
    return np.bincount((mix(s) >> _U(40)).astype(np.int64) % groups, minlength=groups).astype("<i4")


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    return p.reshape(-1, groups).sum(0)


def overlap_bound(p: np.ndarray, q: np.ndarray) -> int:
    """The summed minima of two points, on as many coordinates as both have."""
    groups = min(len(p), len(q))
    return int(np.minimum(folded(p, groups), folded(q, groups)).sum())


class RTree:
    """A packed R-tree over count points: nodes hold the upper corner and the range of sizes of `fan` children."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.order = np.lexsort((points.argmax(1), sizes))
        self.fan, self.levels = fan, [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > fan:
            corner, low, high = self.levels[-1]
            at = np.arange(0, len(corner), fan)
            self.levels.append((np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, q: np.ndarray, n: int, classes: Classes) -> np.ndarray:
        """The points whose bound allows a link with a set of size n at q."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[depth]
            if depth < len(self.levels) - 1:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(corner)]
            fits = (classes.num * n <= classes.den * high[at]) & (classes.num * low[at] <= classes.den * n)
            at = at[fits]
            at = at[np.minimum(corner[at], q).sum(1) >= classes.need(n, low[at])]
        return self.order[at]


def jaccard_links(docs: DataFrame, *, width: int = 3, threshold: tuple[int, int] = (90, 100), chunk_chars: int = 8_000_000, most: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row. threshold: a link is den * overlap >= num * union.

    most: points in an R-tree of the second round; larger blocks are searched in parts.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = total_chars(own)
    # a set of n has about n * (den - num) / num keys in each of two schemes: so many that few may be held repeated falsely
    shape = Sketch(max(1, total * (threshold[1] - threshold[0]) // (3 * threshold[0])), 1, 65_536)
    chunked = with_chunks(own, chunk_chars, "doc_id", "text", total)
    num, den = threshold

    def prepared(group):
        """Sets of the group's rows, their digests, for each the first row that has it, and the keys of those rows."""
        sets, classes = shingle_sets(group.column("text"), width), Classes(num, den)
        with np.errstate(over="ignore"):
            digest = [(int(mix(s ^ _U(0x3C6EF372FE94F82B)).sum(dtype=_U)), int(mix(s ^ _U(0xA54FF53A5F1D36F1)).sum(dtype=_U))) for s in sets]
        ids = group.column("doc_id").combine_chunks().fill_null(_LATE).to_numpy()
        first: dict = {}
        for i in np.argsort(ids, kind="stable").tolist():
            first.setdefault(digest[i], i)
        firsts = sorted(first.values())
        keys = [block_keys(sets[i], classes) for i in firsts]
        row = np.repeat(np.array(firsts, np.int64), [len(k) for k in keys])
        return sets, digest, firsts, row, np.concatenate(keys) if keys else np.zeros(0, _U)

    def sketch(key, group):
        _, _, _, row, keys = prepared(group)
        out = [(n, pack_cells(used, several, shape.size)) for n, used, several, _, _ in shape.cells(keys, row) if len(used)]
        numbers, cells = zip(*out, strict=True) if out else ((), ())
        return pa.table({"segment": pa.array(numbers, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()), "cells": pa.array(cells, pa.binary())})

    def merge(key, group):
        return merge_sketches(group, shape)

    def give(key, group, marks):
        sets, digest, firsts, row, keys = prepared(group)
        twice = repeated(shape, keys, row, marks)
        n = len(sets)
        s, p, k = [None] * n, [None] * n, [None] * n
        cuts = np.searchsorted(row, np.array([*firsts, n]))
        for x, i in enumerate(firsts):
            mine = keys[cuts[x] : cuts[x + 1]][twice[cuts[x] : cuts[x + 1]]]
            if len(mine) >= SHARED:
                s[i], p[i], k[i] = sets[i].astype("<u8").tobytes(), point(sets[i]).tobytes(), signed(mine)
        as_long = lambda j: pa.array(np.array([d[j] for d in digest], _U).view(np.int64))
        return pa.table({"doc_id": group.column("doc_id"), "n": pa.array([len(x) for x in sets], pa.int64()), "d1": as_long(0), "d2": as_long(1), "s": pa.array(s, pa.binary()), "p": pa.array(p, pa.binary()), "keys": pa.array(k, pa.list_(pa.int64()))})

    sketches = chunked.groupBy("chunk").applyInArrow(sketch, "segment long, chunk long, cells binary")
    marks = sketches.groupBy("segment").applyInArrow(merge, "segment long, chunk long, marks binary")
    given = chunked.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(give, "doc_id long, n long, d1 long, d2 long, s binary, p binary, keys array<long>")
    rows = saved(given.withColumn("id", F.coalesce("doc_id", F.lit(_LATE))), "sets")

    same = rows.where(F.col("n") > 0).groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    member = rows.where(F.col("n") > 0).select("id", "n", "d1", "d2").distinct()
    least = member.join(same, ["n", "d1", "d2"])  # every id with a set, and the least id with the same set
    with_keys = rows.where(F.col("keys").isNotNull())
    reps = saved(with_keys.select("id", "n", "d1", "d2", "p", "keys").join(same, ["n", "d1", "d2"]).where(F.col("id") == F.col("rep")).select("id", "n", "p", "keys"), "reps")
    sets = with_keys.select("id", "s")
    in_block = reps.select(F.explode("keys").alias("key"), "id")

    found = verify(star_pairs(with_least(in_block), SHARED), reps, sets, threshold)
    links = saved(found, "found")
    known = components(links)
    rest = search_open(in_block, known, reps, threshold, most)
    more = saved(verify(rest, reps, sets, threshold), "found")
    if more.limit(1).count():
        known = components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))  # a component is a star
    of = known.select(F.col("id").alias("_rep"), "component")
    known = least.join(of, F.col("rep") == F.col("_rep"), "left").select("id", F.coalesce("component", "rep").alias("component"))
    if least.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():  # ids with several sets join what these join
        known = components(known.select(F.col("id").alias("a"), F.col("component").alias("b")))
    of = known.select(F.col("id").alias("_id"), "component")
    out = rows.join(of, rows.id == of["_id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("c"))
    return out.select("doc_id", "n_shingles", F.when(F.col("c") != _LATE, F.col("c")).alias("component_id"))


def verify(pairs: DataFrame, reps: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) that link: first the bound by their points, then the sets."""
    num, den = threshold

    def bound(batches):
        classes = Classes(num, den)
        for b in batches:
            need = classes.need(b.column(2).to_numpy(), b.column(4).to_numpy()).tolist()
            keep = [overlap_bound(np.frombuffer(p.as_buffer(), "<i4"), np.frombuffer(q.as_buffer(), "<i4")) >= k for p, q, k in zip(b.column(3), b.column(5), need, strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def compare(batches):
        classes = Classes(num, den)
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= classes.need(len(x), len(y)))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    near = reps.select(F.col("id").alias("_a"), F.col("n").alias("na"), F.col("p").alias("pa"))
    far = reps.select(F.col("id").alias("_b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    both = pairs.join(near, F.col("a") == F.col("_a")).join(far, F.col("b") == F.col("_b")).select("a", "b", "na", "pa", "nb", "pb")
    likely = saved(both.mapInArrow(bound, "a long, b long"), "likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if ids.count() <= BROADCAST_IDS:  # then only the sets of these are shuffled
        sets = sets.join(F.broadcast(ids), "id", "left_semi")
    near, far = sets.select(F.col("id").alias("_a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("_b"), F.col("s").alias("sb"))
    return likely.join(near, F.col("a") == F.col("_a")).join(far, F.col("b") == F.col("_b")).select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def search_open(in_block: DataFrame, known: DataFrame, reps: DataFrame, threshold: tuple[int, int], most: int) -> DataFrame:
    """Pairs (a, b) of different components in one block that the bound of their points allows."""
    num, den = threshold

    def search(group):
        ids, sizes = (group.column(c).to_numpy() for c in ("id", "n"))
        whole, classes, a, b = [np.frombuffer(p.as_buffer(), "<i4") for p in group.column("p")], Classes(num, den), [], []
        points = np.array([folded(p, GROUPS) for p in whole])
        tree = RTree(points, sizes)
        for x, ys in pairs_to_test(group):
            hit = np.intersect1d(tree.search(points[x], int(sizes[x]), classes), ys, assume_unique=True)
            hit = np.array([y for y in hit.tolist() if overlap_bound(whole[x], whole[y]) >= classes.need(int(sizes[x]), int(sizes[y]))], np.int64)
            a += [int(ids[x])] * len(hit)
            b += ids[hit].tolist()
        return a, b

    points = reps.select(F.col("id").alias("_id"), "n", "p")
    members = open_blocks(with_least(in_block), known, most).join(points, F.col("id") == F.col("_id"))
    return search_blocks(members, search, "a long, b long").distinct()
