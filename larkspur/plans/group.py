"""$group: accumulators as partial aggregations, document order carried where it matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import kind_of
from ..functions.values import Kind
from .order import numbered, order_struct
from .projection import HIDDEN, expression, hidden, schema_of

ORDERED = {"$first", "$last", "$push", "$addToSet"}
PLAIN = {"$sum", "$avg", "$min", "$max", "$count"}


def accumulators(spec: dict) -> dict[str, tuple[str, object]]:
    out = {}
    for name, x in spec.items():
        if name == "_id":
            continue
        if not isinstance(x, dict) or len(x) != 1:
            continue  # not an accumulator: the field is left out
        (op, arg), = x.items()
        if op not in ORDERED | PLAIN:
            raise ValueError(f"unknown group operator {op}")
        out[name] = op, arg
    return out


def needs_order(spec: dict) -> bool:
    return any(op in ORDERED for op, _ in accumulators(spec).values())


def _value(df: DataFrame, op: str, arg) -> Column:
    schema = schema_of(df)
    c = expression(schema, arg)
    if op == "$count":
        return F.count(F.lit(1))
    dtype = df.select(c.alias("v")).schema[0].dataType
    if op in ("$sum", "$avg"):  # always double; other than numbers count as 0 but do count
        total = F.coalesce(F.sum(c.cast("double")), F.lit(0.0)) if kind_of(dtype) == Kind.NUMBER else F.lit(0.0) * F.count(F.lit(1))
        return total if op == "$sum" else total / F.count(F.lit(1))
    if op == "$min":  # a null is below all values
        return F.when(F.count(c) == F.count(F.lit(1)), F.min(c))
    if op == "$max":
        return F.max(c)
    order = order_struct(df)
    if op in ("$first", "$last"):  # both keep nulls among the values
        return (F.min_by if op == "$first" else F.max_by)(c, order)
    pushed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("v")))), lambda e: e["v"])
    return pushed if op == "$push" else F.array_distinct(pushed)


def group(df: DataFrame, spec: dict, keep_order: bool) -> DataFrame:
    """A row per distinct _id, none for an empty input. keep_order: groups get the place of their first document."""
    if "_id" not in spec:
        spec = {"_id": None, **spec}
    schema, key = schema_of(df), spec["_id"]
    if isinstance(key, dict):
        by = F.struct(*[expression(schema, x).alias(k) for k, x in key.items()]) if key else F.struct(F.lit(None).alias("_"))
    else:
        by = expression(schema, key)
    if isinstance(key, dict) and not key:
        by = F.lit(None)
    if hidden(df) and order_struct(df) is None and (keep_order or needs_order(spec)):
        df = numbered(df, None if keep_order else by)
    values = [_value(df, op, arg).alias(name) for name, (op, arg) in accumulators(spec).items()]
    place = [F.min(order_struct(df)).alias(f"{HIDDEN}0")] if keep_order and hidden(df) else []
    out = df.groupBy(by.alias("_id")).agg(*([*values, *place] or [F.count(F.lit(1)).alias("__rows")]))
    return out.drop("__rows")
