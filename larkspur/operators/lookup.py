"""$lookup: each document with the array of foreign documents that have an equal key.

Equality is null-safe, and a missing key is null. The foreign side is grouped by key once, before the join; where only the
joined rows or their existence are wanted, it is joined as it is, and the engine picks broadcast, hash or sort-merge by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import column, kind_of, resolve
from ..plans.order import add_level, with_position
from ..plans.projection import hidden, schema_of, visible


def _key(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    ref = resolve(schema_of(df), path) if path else None
    if ref is None:
        return F.lit(None).cast("string"), T.NullType()
    return (ref.value if ref.present is None else F.when(ref.present, ref.value)), ref.dtype


def _keys(left: DataFrame, right: DataFrame, spec: dict) -> tuple[Column, Column]:
    """Both keys. Of different kinds only nulls are equal, so a key that can't match is null or matches nothing."""
    (a, s), (b, t) = _key(left, spec["localField"]), _key(right, spec["foreignField"])
    if kind_of(s) != kind_of(t):  # compared as the words null and other: no cast between kinds
        return F.when(a.isNotNull(), F.lit("l")), F.when(b.isNotNull(), F.lit("r"))
    return a, b


def _documents(df: DataFrame) -> Column:
    return F.struct(*[column(c) for c in visible(df)])


def lookup(left: DataFrame, foreign, spec: dict) -> DataFrame:
    name = spec["as"]
    if foreign is None:
        return left.withColumn(name, F.array())
    right = with_position(foreign.df, foreign.natural)
    a, b = _keys(left, foreign.df, spec)
    order = F.struct(*[F.col(c) for c in hidden(right)])
    matched = right.select(b.alias("__key"), F.struct(order.alias("o"), _documents(right).alias("d")).alias("__item")).groupBy("__key").agg(F.transform(F.array_sort(F.collect_list("__item")), lambda e: e["d"]).alias("__found"))
    out = left.withColumn("__local", a).join(matched, F.col("__local").eqNullSafe(F.col("__key")), "left")
    empty = F.array().cast(T.ArrayType(_documents_type(foreign.df)))
    return out.withColumn(name, F.coalesce("__found", empty)).drop("__local", "__key", "__found")


def _documents_type(df: DataFrame) -> T.StructType:
    return df.select(_documents(df).alias("d")).schema[0].dataType


def flat_lookup(left: DataFrame, foreign, spec: dict, preserve: bool) -> DataFrame:
    """$lookup and $unwind of its array: a row per match; preserve keeps documents without one."""
    name = spec["as"]
    if foreign is None:
        return left.withColumn(name, F.lit(None)) if preserve else left.withColumn(name, F.lit(None)).where(F.lit(False))
    right = with_position(foreign.df, foreign.natural) if hidden(left) else foreign.df
    a, b = _keys(left, foreign.df, spec)
    place = [F.struct(*[F.col(c) for c in hidden(right)]).alias("__place")] if hidden(left) else []
    matched = right.select(b.alias("__key"), _documents(right).alias("__item"), *place)
    out = left.withColumn("__local", a).join(matched, F.col("__local").eqNullSafe(F.col("__key")), "left" if preserve else "inner")
    out = out.withColumn(name, F.col("__item"))
    if place:
        out = add_level(out, F.col("__place")).drop("__place")
    return out.drop("__local", "__key", "__item")


def semi_lookup(left: DataFrame, foreign, spec: dict, anti: bool) -> DataFrame:
    """Documents without a match, their array empty; or those with one, without the array."""
    name = spec["as"]
    if foreign is None:
        return left.withColumn(name, F.array()) if anti else left.where(F.lit(False))
    a, b = _keys(left, foreign.df, spec)
    keys = foreign.df.select(b.alias("__key"))
    out = left.withColumn("__local", a).join(keys, F.col("__local").eqNullSafe(F.col("__key")), "left_anti" if anti else "left_semi").drop("__local")
    return out.withColumn(name, F.array().cast(T.ArrayType(_documents_type(foreign.df)))) if anti else out.drop(name)

