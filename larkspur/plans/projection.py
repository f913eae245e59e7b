"""Projections and the stages that reshape documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import column, drop_path, field, resolve, set_path
from ..functions.predicates import constant
from ..functions.values import is_number

#: Columns that carry document order through a pipeline start so; they are not part of a document.
HIDDEN = "__order_"


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]


def hidden(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(HIDDEN)]


def schema_of(df: DataFrame) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if not f.name.startswith(HIDDEN)])


def is_inclusion(spec: dict) -> bool:
    """The first number that isn't for _id decides; without one, inclusion."""
    return next((v != 0 for k, v in spec.items() if k != "_id" and is_number(v)), True)


def project(df: DataFrame, spec: dict) -> DataFrame:
    """Inclusion gives _id first, unless it is 0, then the fields in the order of spec; exclusion drops top-level
    names. Values other than numbers select nothing."""
    schema, keep_id = schema_of(df), not (is_number(spec.get("_id")) and spec["_id"] == 0)
    extra = [column(c) for c in hidden(df)]
    if not is_inclusion(spec):
        gone = {k for k, v in spec.items() if is_number(v) and v == 0}
        gone = gone - {"_id"} if keep_id else gone | {"_id"}
        return df.select(*[column(c) for c in visible(df) if c not in gone], *extra)
    tree: dict = {"_id": {}} if keep_id and field(schema, "_id") else {}
    for path, v in spec.items():
        if path != "_id" and is_number(v) and v != 0 and resolve(schema, path) is not None:
            at = tree
            for part in path.split(".") if field(schema, path) is None else [path]:
                at = at.setdefault(part, {})
    return df.select(*[_pick(column(k), field(schema, k).dataType, sub).alias(k) for k, sub in tree.items()], *extra)


def _pick(c: Column, dtype: T.DataType, tree: dict) -> Column:
    if not tree or not isinstance(dtype, T.StructType):
        return c
    inner = [_pick(c.getField(k), field(dtype, k).dataType, sub).alias(k) for k, sub in tree.items()]
    return F.when(c.isNotNull(), F.struct(*inner))


def expression(schema: T.StructType, x) -> Column:
    """"$path" or a literal; a missing path is null."""
    if isinstance(x, str) and x.startswith("$"):
        ref = resolve(schema, x[1:])
        return ref.value if ref is not None else F.lit(None)
    return constant(x)


def add_fields(df: DataFrame, spec: dict) -> DataFrame:
    """All values are taken from the input; a dotted target makes documents on its way."""
    schema, tops = schema_of(df), {}
    for path, x in spec.items():
        top, *rest = path.split(".")
        if not rest:
            tops[top] = expression(schema, x), None
            continue
        old, dtype = tops.get(top, (None, None))
        if old is None and (f := field(schema, top)) is not None:
            old, dtype = column(top), f.dataType
        value = set_path(old, dtype, rest, expression(schema, x))
        tops[top] = value, df.select(value.alias("v")).schema[0].dataType
    return df.withColumns({k: c for k, (c, _) in tops.items()})


def unset(df: DataFrame, paths: list[str]) -> DataFrame:
    for path in paths:
        schema = schema_of(df)
        if field(schema, path) is not None:
            df = df.drop(path)
        elif len(parts := path.split(".")) > 1 and (f := field(schema, parts[0])) is not None:
            df = df.withColumn(parts[0], drop_path(column(parts[0]), f.dataType, parts[1:]))
    return df


def replace_root(df: DataFrame, spec) -> DataFrame:
    if not isinstance(spec, dict) or "newRoot" not in spec:
        raise ValueError("$replaceRoot needs newRoot")
    new, schema, extra = spec["newRoot"], schema_of(df), [column(c) for c in hidden(df)]
    if isinstance(new, dict):
        return df.select(*[expression(schema, x).alias(k) for k, x in new.items()], *extra)
    ref = resolve(schema, new[1:]) if isinstance(new, str) and new.startswith("$") else None
    if ref is None or not isinstance(ref.dtype, T.StructType):  # not a document in any row
        return df.where(F.lit(False)).select(*extra)
    return df.where(ref.value.isNotNull()).select(*[ref.value.getField(f.name).alias(f.name) for f in ref.dtype.fields], *extra)
