"""Filters as columns: `compile_filter` gives a boolean column that is never null.

Every leaf is decided against the schema: a comparison with another kind, an unknown path or an unknown operator becomes a
constant, which the optimizer folds; the rest are plain comparisons that reach the scan.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Ref, Scope, column, kind_of, resolve, type_number_of
from ..functions.predicates import constant, equals, ordered, sure
from ..functions.values import TYPE_NAMES, Kind, is_number, kind, literal


def _every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def compile_filter(filter_: dict, schema: T.StructType, scope: Scope = column) -> Column:
    return _document(literal(filter_), schema, scope)


def _document(filter_: dict, schema: T.StructType, scope: Scope) -> Column:
    return _every([_entry(k, v, schema, scope) for k, v in filter_.items()])


def _entry(key: str, wanted, schema: T.StructType, scope: Scope) -> Column:
    if key in ("$and", "$or", "$nor"):
        if not isinstance(wanted, list):
            return F.lit(key == "$nor")
        tests = [_document(f, schema, scope) for f in wanted if isinstance(f, dict)]
        return _every(tests) if key == "$and" else _any(tests) if key == "$or" else ~_any(tests)
    if key == "$not":
        return ~_document(wanted, schema, scope) if isinstance(wanted, dict) else F.lit(True)
    ref = resolve(schema, key, scope)
    if isinstance(wanted, dict):  # always operators: {} matches all, {"k": v} nothing
        return _every([_operator(ref, op, x) for op, x in wanted.items()])
    return equals(ref, wanted)


def _operator(ref: Ref | None, op: str, x) -> Column:
    if op == "$eq":
        return equals(ref, x)
    if op == "$ne":
        return ~equals(ref, x)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return ordered(ref, op, x)
    if op == "$in":
        return _in(ref, x)
    if op == "$nin":
        return ~_in(ref, x)
    if op == "$exists":
        return _exists(ref) if x is not False else ~_exists(ref)
    if op == "$type":
        return _type(ref, x)
    if op == "$regex":
        return _regex(ref, x)
    if op in ("$size", "$all", "$elemMatch"):
        return _array(ref, op, x)
    if op == "$mod":
        return _mod(ref, x)
    return F.lit(False)


def _exists(ref: Ref | None) -> Column:
    return F.lit(ref is not None) if ref is None or ref.present is None else sure(ref.present)


def _in(ref: Ref | None, values) -> Column:
    if ref is None or not isinstance(values, list):
        return F.lit(False)
    simple = [v for v in values if kind(v) == kind_of(ref.dtype) and (kind(v) == Kind.STRING or isinstance(ref.dtype, T.IntegralType) and isinstance(v, int) and abs(v) < 2**63)]
    tests = [equals(ref, v) for v in values if not any(v is s for s in simple)]
    if simple:
        there = ref.present if ref.present is not None else F.lit(True)
        tests.append(there & ref.value.isNotNull() & ref.value.isin([constant(v) for v in simple]))
    return _any(tests)


def _type(ref: Ref | None, x) -> Column:
    n = TYPE_NAMES.get(x) if isinstance(x, str) else x if isinstance(x, int) and not isinstance(x, bool) else None
    if ref is None or n is None:
        return F.lit(False)
    there = _exists(ref)
    if n == 10:
        return there & ref.value.isNull()
    return there & ref.value.isNotNull() if type_number_of(ref.dtype) == n else F.lit(False)


def valid_pattern(pattern: str) -> bool:
    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def _regex(ref: Ref | None, pattern) -> Column:
    if ref is None or kind_of(ref.dtype) != Kind.STRING or not isinstance(pattern, str) or not valid_pattern(pattern):
        return F.lit(False)
    return ref.value.isNotNull() & ref.value.rlike(pattern)


def _is(items: T.DataType, v):
    return lambda e: equals(Ref(e, items), v)


def _array(ref: Ref | None, op: str, x) -> Column:
    if ref is None or not isinstance(ref.dtype, T.ArrayType):
        return F.lit(False)
    items = ref.dtype.elementType
    if op == "$size":
        return sure(F.size(ref.value) == int(x)) if is_number(x) and math.isfinite(x) and abs(x) < 2**31 else F.lit(False)
    if op == "$all":
        if not isinstance(x, list):
            return F.lit(False)
        return sure(ref.value.isNotNull() & _every([F.exists(ref.value, _is(items, v)) for v in x]))
    if not isinstance(x, dict) or not isinstance(items, T.StructType):
        return F.lit(False)
    return sure(F.exists(ref.value, lambda e: e.isNotNull() & _document(x, items, lambda name: e.getField(name))))


def _mod(ref: Ref | None, x) -> Column:
    if ref is None or kind_of(ref.dtype) != Kind.NUMBER or not (isinstance(x, list) and len(x) == 2 and all(map(is_number, x)) and all(map(math.isfinite, x))) or int(x[0]) == 0:
        return F.lit(False)
    whole = ref.value if isinstance(ref.dtype, T.IntegralType) else ref.value.try_cast("bigint")
    return sure(whole % F.lit(int(x[0])) == int(x[1]))
