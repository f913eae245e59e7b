"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A keyed hash permutes each source's documents and cuts them into blocks (the hash's leading bits). Targets
are shares of an overall size by weight, each at most `most` times its source's size. A source gives whole
copies of all its documents, and a further prefix of its permuted blocks up to its quota of words; the last block is cut
again by the next bits, until single documents decide. A splitting tree deals the exact counts of
taken blocks to output shards: each node draws, without replacement, how many blocks of each source
go to its left half. The blocks then go to shards in a keyed order, and rows within a shard take a hashed order.

All decisions follow from a document's hash and a small table with a row per source, so they shuffle neither
texts nor a hot source's documents, and reruns agree. Only `draw` moves rows, once, to their shards.

Nulls: a null text has no words; a null source is a source of its own, last; a null doc_id hashes as
such. Repeated rows of an id, and ids of equal hash, are taken alike. A text of any length counts by its words. An empty table gives no
rows. Extra columns pass through `mix`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import saved
from .text import sql_words

#: Bits of the permuting hash, and how many of them cut one level of blocks.
HASH_BITS, LEVEL_BITS = 60, 10
#: With more sources than this, the table of rules is joined and not broadcast.
BROADCAST_SOURCES = 1_000


def n_words(text: Column) -> Column:
    return F.size(sql_words(text)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of `total` by weight; a share stops at most * size, and the excess is reshared by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        all_weights = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / all_weights > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / all_weights
            break
        for i in over:
            out[i] = most * float(sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts: blocks of each source. (shards, sources): how many of them each shard gets.

    Each node parts its blocks between two halves of its shards, by their sizes, as a draw without
    replacement would: one hypergeometric draw a source, given what the sources before it took.
    """
    out = np.zeros((shards, len(counts)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, rng = (lo + hi) // 2, np.random.Generator(np.random.Philox(key=[seed, lo << 32 | hi]))
        want, rest, left = int(have.sum()) * (mid - lo) // (hi - lo), int(have.sum()), np.zeros_like(have)
        for i, n in enumerate(have.tolist()):
            rest -= n
            left[i] = rng.hypergeometric(n, rest, want) if n and rest and want else min(n, want)
            want -= left[i]
        node(lo, mid, left)
        node(mid, hi, have - left)

    if shards:
        node(0, shards, counts)
    return out


def _hash(id_col: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 64 - HASH_BITS)


def plan(sized: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 64, seed: int = 7) -> list[dict]:
    """A rule per source: its size and target, whole copies, the hash below which a document is taken once
    more, and the shards of its blocks. sized: columns source, size, h (the permuting hash).

    A source's blocks are summed in order where they are, 2**LEVEL_BITS of them at a time; the driver gets a row per source and level.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    totals = sorted(totals, key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes, wide = [r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))]
    rules = [{"source": r.source, "size": r["size"], "target": t} for r, t in zip(totals, targets(sizes, wide, share * sum(sizes), most), strict=True)]
    for x in rules:
        x["copies"] = int(x["target"] // x["size"]) if x["size"] else 1
        x["quota"], x["below"], x["open"] = x["target"] - x["copies"] * x["size"] if x["size"] else 0.0, 0, True
    level, width = 0, 1 << LEVEL_BITS
    while level * LEVEL_BITS < HASH_BITS and (going := [x for x in rules if x["open"] and x["quota"] > 0]):
        shift = HASH_BITS - (level + 1) * LEVEL_BITS
        table = sized.sparkSession.createDataFrame([(i, x["source"], x["below"] >> (shift + LEVEL_BITS), x["quota"]) for i, x in enumerate(going)], "i int, s string, p long, quota double")
        table = F.broadcast(table) if len(going) <= BROADCAST_SOURCES else table
        of, block = sized["source"].eqNullSafe(table["s"]), F.shiftright("h", shift).alias("b")
        sums = F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
        if level:  # few documents are in the blocks that are cut
            blocks = sized.join(table, of & (F.shiftright("h", shift + LEVEL_BITS) == table["p"])).groupBy("i", "quota", block).agg(*sums)
        else:  # a hot source's documents are summed before they meet their rule
            blocks = sized.groupBy("source", block).agg(*sums).join(table, of)
        order = Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**LEVEL_BITS blocks of a source
        cut = F.when(F.col("sum") > F.col("quota"), F.struct("b", "size", "n", "sum"))
        for r in blocks.withColumn("sum", F.sum("size").over(order)).groupBy("i").agg(F.min(cut).alias("cut"), F.max("b").alias("last")).collect():
            x = going[r.i]
            if r.cut is None:  # all blocks are taken: only where the sizes' sum is the quota itself
                x["below"], x["open"] = (r["last"] + 1) << shift, False
                continue
            x["quota"] -= r.cut["sum"] - r.cut["size"]
            x["below"], x["open"] = r.cut["b"] << shift, r.cut["n"] > 1
            if r.cut["n"] == 1 and r.cut["size"] - x["quota"] < x["quota"]:  # the nearer side of a single document
                x["below"] = (r.cut["b"] + 1) << shift
        level += 1
    taken = [((min(width, (x["below"] >> (HASH_BITS - LEVEL_BITS)) + 1) if x["below"] else 0) + x["copies"] * width) for x in rules]
    dealt = split_tree(np.array(taken, np.int64), shards, seed) if rules else np.zeros((shards, 0), np.int64)
    for i, x in enumerate(rules):
        of_block = np.repeat(np.arange(shards), dealt[:, i])
        x["shards"] = np.random.Generator(np.random.Philox(key=[seed, i])).permutation(of_block).tolist()
    return rules


def with_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with mix_size, the words of their texts."""
    return docs.withColumn("mix_size", n_words(F.col(text_col)))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with mix_size (words), mix_source_size, mix_target, mix_copies (how often a document is taken) and mix_shards, the
    output shard of each of its copies. No document is taken more than `most` times. docs without a text column have mix_size, from `with_sizes`."""
    spark = docs.sparkSession
    own = {id_col, text_col, source_col} | (set() if text_col in docs.columns else {"mix_size"})
    docs = docs.drop(*({"mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_shards"} - own))
    docs = with_sizes(docs, text_col) if text_col in docs.columns else docs
    keyed = docs.withColumns({"__ls_h": _hash(F.col(id_col), seed), "__ls_source": F.col(source_col).cast("string")})
    sized = keyed.select(F.col("__ls_source").alias("source"), F.col("mix_size").alias("size"), F.col("__ls_h").alias("h"))
    rules = plan(saved(sized, "sizes"), weights=weights, share=share, most=most, shards=shards, seed=seed)
    schema = T.StructType([T.StructField("__ls_s", T.StringType()), T.StructField("mix_source_size", T.LongType()), T.StructField("mix_target", T.DoubleType()), T.StructField("__ls_copies", T.LongType()), T.StructField("__ls_below", T.LongType()), T.StructField("__ls_shards", T.ArrayType(T.IntegerType()))])
    table = spark.createDataFrame([(x["source"], x["size"], x["target"], x["copies"], x["below"], x["shards"]) for x in rules], schema)
    table = F.broadcast(table) if len(rules) <= BROADCAST_SOURCES else table
    block, width = F.shiftright("__ls_h", HASH_BITS - LEVEL_BITS).cast("int"), 1 << LEVEL_BITS
    out = keyed.join(table, keyed["__ls_source"].eqNullSafe(table["__ls_s"]))
    out = out.withColumn("mix_copies", F.col("__ls_copies") + (F.col("__ls_h") < F.col("__ls_below")).cast("long"))
    places = F.transform(F.sequence(F.lit(0), F.col("mix_copies").cast("int") - 1), lambda c: F.get("__ls_shards", c * width + block))
    out = out.withColumn("mix_shards", F.when(F.col("mix_copies") > 0, places).otherwise(F.array().cast("array<int>")))
    return out.drop("__ls_h", "__ls_source", "__ls_s", "__ls_copies", "__ls_below", "__ls_shards")


def draw(docs: DataFrame, *, seed: int = 7, shards: int = 64, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixture's rows: each document as often as it is taken, with its shard, and `mix_order`. Rows are laid out by
    them: a shard's rows are in one partition, one after another in the shuffled order."""
    mixed = mix(docs, seed=seed, shards=shards, id_col=id_col, **options)
    out = mixed.select(*docs.columns, F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    out = out.withColumn("mix_order", F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("mix_copy")))
    return out.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")
