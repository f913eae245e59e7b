"""Distributed union-find: connected components of a table of links.

Large and small stars by turns: each node hands its neighbours on to its least neighbour, until every
component is a star around its least node. Minima are aggregated before they are shuffled and joined back, so a node
with very many links is neither gathered nor windowed; the join may split it. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def _least(links: DataFrame) -> DataFrame:
    """links u, v with m, the least of u and its v's."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return links.join(least, links.u == least["_u"]).select("u", "v", "m")


def unfinished(edges: DataFrame) -> bool:
    """Whether some node has two parents, or a parent that is no root."""
    counts = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    several = counts.where("n > 1").select(F.lit(1).alias("x"))
    inner = edges.select("v").distinct().join(counts, F.col("v") == F.col("u"), "left_semi").select(F.lit(1).alias("x"))
    return several.unionAll(inner).limit(1).count() > 0


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b of any orderable type, not null. id and component (the least id) of every
    node that isn't its component's least."""
    turned = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = saved(links.where(F.col("a") != F.col("b")).select(turned.alias("e")).select("e.*").distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        down = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = saved(small.select(down.alias("e")).select("e.*").where(F.col("u") != F.col("v")).distinct(), "links")
        if not unfinished(edges):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
