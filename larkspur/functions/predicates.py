"""Comparisons of a column with a literal under the total order over kinds. Results are never null."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Ref, field, kind_of
from .values import Kind, is_number, kind

_OPS = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}
_INT64 = 2**63


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def constant(value) -> Column:
    """A literal as a column: documents as structs, arrays as arrays."""
    if isinstance(value, dict):
        return F.struct(*[constant(v).alias(k) for k, v in value.items()])
    if isinstance(value, list | tuple):
        return F.array(*map(constant, value))
    if isinstance(value, bytearray):
        value = bytes(value)
    if isinstance(value, str):
        value = str(value)
    return F.lit(value)


def _integers(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def fitting(v, dtype: T.DataType) -> Column:
    """A literal of the column's own kind. A moment without a zone is in UTC, whatever the session's zone."""
    if kind(v) == Kind.DATE and isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        if isinstance(v, dt.datetime) and v.tzinfo:
            v = v.astimezone(dt.UTC).replace(tzinfo=None)
        text = v.isoformat(" ") if isinstance(v, dt.datetime) else f"{v.isoformat()} 00:00:00"
        return F.lit(text if isinstance(dtype, T.TimestampNTZType) else f"{text}Z").cast(dtype)
    return constant(v)


def number_test(c: Column, dtype: T.DataType, op: str, v) -> Column:
    """c op v without loss, for integers beyond 2**53 and literals beyond 64 bits. null if c is."""
    if isinstance(v, float) and math.isnan(v):
        nan = F.isnan(c) if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType) else F.lit(False)
        return {"$eq": nan, "$gt": F.lit(False), "$gte": nan, "$lt": ~nan, "$lte": F.lit(True)}[op]
    if _integers(dtype):
        if v >= _INT64 or v < -_INT64:
            return F.lit(False) if op == "$eq" else F.lit((op in ("$lt", "$lte")) == (v > 0))
        low, high = math.floor(v), math.ceil(v)
        if op == "$eq":
            return c == F.lit(low) if low == high else F.lit(False)
        return {"$gt": lambda: c > F.lit(low), "$gte": lambda: c >= F.lit(high), "$lt": lambda: c < F.lit(high), "$lte": lambda: c <= F.lit(low)}[op]()
    if isinstance(dtype, T.DecimalType) and isinstance(v, int) and abs(v) < 10**38:
        v = decimal.Decimal(v)
    elif isinstance(v, int):
        near = float(v) if abs(v) < 2**1023 else math.copysign(math.inf, v)
        if math.isinf(near) or int(near) != v:  # between two doubles
            if op == "$eq":
                return F.lit(False)
            above = math.isinf(near) and near > 0 or not math.isinf(near) and int(near) > v
            op = {"$gt": "$gte", "$gte": "$gte", "$lt": "$lt", "$lte": "$lt"}[op] if above else {"$gt": "$gt", "$gte": "$gt", "$lt": "$lte", "$lte": "$lte"}[op]
        v = near
    return c == F.lit(v) if op == "$eq" else _OPS[op](c, F.lit(v))


def equals(ref: Ref | None, v) -> Column:
    """Missing equals nothing, a null only a null."""
    if ref is None:
        return F.lit(False)
    there = ref.present if ref.present is not None else F.lit(True)
    if v is None:
        return there & ref.value.isNull()
    if kind_of(ref.dtype) != kind(v):
        return F.lit(False)
    if is_number(v):
        return there & ref.value.isNotNull() & number_test(ref.value, ref.dtype, "$eq", v)
    if isinstance(v, dict):
        if isinstance(ref.dtype, T.MapType) or [f.name for f in ref.dtype.fields] != list(v):
            return F.lit(False)
        test = ref.value.isNotNull()
        for k, x in v.items():
            test = test & equals(Ref(ref.value.getField(k), field(ref.dtype, k).dataType), x)
        return sure(there & test)
    if isinstance(v, list):
        test = ref.value.isNotNull() & (F.size(ref.value) == len(v))
        for i, x in enumerate(v):
            test = test & equals(Ref(F.get(ref.value, F.lit(i)), ref.dtype.elementType), x)
        return sure(there & test)
    return there & ref.value.isNotNull() & (ref.value == fitting(v, ref.dtype))


def ordered(ref: Ref | None, op: str, v) -> Column:
    """$gt, $gte, $lt, $lte: other kinds compare by rank, so a null is below all values but minKey."""
    if ref is None:
        return F.lit(False)
    there, rank = ref.present if ref.present is not None else F.lit(True), kind(v)
    null_test = _OPS[op](int(Kind.NULL), int(rank)) if rank != Kind.NULL else op in ("$gte", "$lte")
    if kind_of(ref.dtype) != rank:
        test = F.lit(_OPS[op](int(kind_of(ref.dtype)), int(rank)))
    elif rank == Kind.NUMBER:
        test = number_test(ref.value, ref.dtype, op, v)
    elif rank == Kind.DOCUMENT:
        test = _documents(ref, op, v)
    elif rank == Kind.ARRAY:
        test = _arrays(ref, op, v)
    else:
        test = _OPS[op](ref.value, fitting(v, ref.dtype))
    # never null, and in a form that scans can take: c is null or c < v; c is not null and c > v
    return there & (ref.value.isNull() | test) if null_test else there & ref.value.isNotNull() & test


def _steps(op: str, steps: list[tuple[Column, Column]], rest: bool | Column) -> Column:
    """The first step that is not equal decides: (less, equal) of each."""
    out = F.lit(rest) if isinstance(rest, bool) else rest
    for less, same in reversed(steps):
        out = F.when(same, out).otherwise(less if op in ("$lt", "$lte") else ~less)
    return out


def _documents(ref: Ref, op: str, v: dict) -> Column:
    names = [f.name for f in ref.dtype.fields] if isinstance(ref.dtype, T.StructType) else []
    if len(names) != len(v):
        return F.lit(_OPS[op](len(names), len(v)))
    steps = []
    for f, (k, x) in zip(ref.dtype.fields, v.items(), strict=True):
        if f.name != k:
            steps.append((F.lit(f.name < k), F.lit(False)))
            break
        inner = Ref(ref.value.getField(k), f.dataType)
        steps.append((ordered(inner, "$lt", x), equals(inner, x)))
    return _steps(op, steps, op in ("$gte", "$lte"))


def _arrays(ref: Ref, op: str, v: list) -> Column:
    steps = []
    for i, x in enumerate(v):
        inner = Ref(F.get(ref.value, F.lit(i)), ref.dtype.elementType, F.size(ref.value) > i)
        ended = F.size(ref.value) <= i
        steps.append((ended | ordered(inner, "$lt", x), equals(inner, x)))
    return _steps(op, steps, _OPS[op](F.size(ref.value), F.lit(len(v))))
