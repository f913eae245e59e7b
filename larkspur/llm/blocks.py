"""Candidate pairs from blocks: rows (key, id) say that id is in the block key.

Links are sought in two rounds, so that a block of very many like rows never gives all its pairs. First members
are paired with their block's least id. Once those links are verified and their components known, only blocks that
still hold members of different components are searched, by the caller, for pairs across components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group of `open_blocks`, as `search_blocks` hands them on.
GROUP = ("key", "kind", "i", "j")
#: Rows of a small group at most: its pairs are few enough to be looked at with those of others.
SMALL = 16


def with_least(rows: DataFrame) -> DataFrame:
    """key, id and b, the block's least id, of the other members. Minima are aggregated before the shuffle and joined back."""
    least = rows.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("_max")).where(F.col("b") != F.col("_max"))
    return rows.join(least.select(F.col("key").alias("_key"), "b"), F.col("key") == F.col("_key")).where(F.col("id") != F.col("b")).select("key", "id", "b")


def star_pairs(others: DataFrame, shared: int = 1) -> DataFrame:
    """a, b: members (of `with_least`) with the least id of their block, where that is so in `shared` blocks or more."""
    pairs = others.groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.where(F.col("n") >= shared).select("a", "b")


def open_blocks(others: DataFrame, components: DataFrame, most: int) -> DataFrame:
    """key, id, component, minor, part, kind, i, j: members of blocks (of `with_least`), without the least that the first round has
    compared with them all, where these are of several components; one block for each distinct set of them.

    The largest component of a block needs no pairs within it, so its members are dealt to parts of `most` and each part meets the
    other, minor, members. Those are dealt to parts too where they are many. A group (key, kind, i, j) holds minor part i, and
    of kind 0 major part j, of kind 1 minor part j: a large group of like rows stays one row a member.
    """
    own = components.select(F.col("id").alias("_id"), F.col("component").alias("_c"))
    others = others.select("key", "id")
    named = others.join(own, others.id == own["_id"], "left").select("key", "id", F.coalesce("_c", "id").alias("component"))
    sums = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    blocks = sums.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    several = blocks.where(F.col("k") > 1).groupBy("n", "x", "y", "top").agg(F.min("key").alias("_key"))
    parts = lambda n: F.ceil(n / most).cast("int")
    kept = several.select("_key", F.col("top.component").alias("_top"), parts(F.col("top.n")).alias("p"), parts(F.col("n") - F.col("top.n")).alias("q"))
    members = named.join(kept, named.key == kept["_key"]).withColumn("minor", F.col("component") != F.col("_top"))
    members = members.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "id"), F.when(F.col("minor"), F.col("q")).otherwise(F.col("p"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    part = F.col("part")
    with_minor = F.transform(F.filter(upto("q"), lambda k: k != part), lambda k: place(1, F.least(part, k), F.greatest(part, k)))
    groups = F.when(F.col("minor"), F.concat(F.transform(upto("p"), lambda k: place(0, part, k)), with_minor)).otherwise(F.transform(upto("q"), lambda k: place(0, k, part)))
    return members.select("key", "id", "component", "minor", "part", F.explode(groups).alias("g")).select("key", "id", "component", "minor", "part", "g.kind", "g.i", "g.j")


def search_blocks(members: DataFrame, search: Callable, schema: str, search_small: Callable | None = None) -> DataFrame:
    """search over each group of `open_blocks`, with what was joined to it; gives a and b of its pairs.

    Groups are small and many, so a task walks its sorted rows and holds one group at a time, and a batch. Groups of at most SMALL
    rows within it go to search_small together, if there is one, with where each begins and its size.
    """

    def run(batches):
        left: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([left, rows]) if left is not None else rows
            ids = [rows.column(c).to_numpy() for c in GROUP]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            edges = [0, *new.tolist()]
            groups = [(lo, hi - lo) for lo, hi in zip(edges, new.tolist(), strict=False)]
            if search_small is not None and (few := [g for g in groups if g[1] <= SMALL]):
                yield from result([search_small(rows, *np.array(few).T)])
                groups = [g for g in groups if g[1] > SMALL]
            yield from result([search(rows.slice(*g)) for g in groups])
            left = rows.slice(edges[-1])
        if left is not None:
            yield from result([search(left)])

    def result(found):
        a, b = [x for pair in found for x in pair[0]], [x for pair in found for x in pair[1]]
        kind = pa.int64() if "long" in schema else pa.binary()
        if a:
            yield pa.record_batch([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return members.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def pairs_to_test(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ys): places in a group whose pairs cross components, each pair of a block once over its groups."""
    minor, part = group.column("minor").to_numpy(), group.column("part").to_numpy()
    _, of = np.unique(group.column("component").to_numpy(), return_inverse=True)
    kind, i, j = (group.column(c)[0].as_py() for c in ("kind", "i", "j"))
    place = np.arange(len(minor))
    for x in np.flatnonzero(minor & (part == i)).tolist():
        if kind:
            ys = part == j
        else:
            ys = ~minor if j else ~minor | (place < x)
        yield x, np.flatnonzero(ys & (of != of[x]))


def small_pairs(rows: pa.Table, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, y) of `pairs_to_test` of many groups, as places in rows."""
    column = lambda c: rows.column(c).to_numpy()
    minor, part, j, component = column("minor"), column("part"), column("j"), column("component")
    begin, own = np.repeat(first, size), np.repeat(size, size)
    x = begin + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    keep = minor[x] & (part[x] == column("i")[x])
    x, begin, own = x[keep], begin[keep], own[keep]
    y = np.repeat(begin, own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    x = np.repeat(x, own)
    across = np.where(column("kind")[x] > 0, part[y] == j[x], ~minor[y] | ((j[x] == 0) & (y < x)))
    keep = across & (component[x] != component[y])
    return x[keep], y[keep]
