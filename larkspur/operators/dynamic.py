"""Collections of documents of any shape: one VARIANT column, missing and null told apart, kinds mixed freely."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import sure
from ..functions.total_order import let, literal_key, rank, sort_key
from ..functions.values import TYPE_NAMES, Kind, is_number, kind, literal
from ..plans.filters import valid_pattern


def at(doc: Column, path: str) -> Column:
    """The variant at a dotted path, null where it is missing. A number is a field's name or an array's element."""
    v = doc
    for part in path.split("."):
        named = F.try_variant_get(v, f"$['{part}']", "variant")
        v = F.coalesce(named, F.try_variant_get(v, f"$[{part}]", "variant")) if part.isdigit() else named
    return v


def compile_dynamic(filter_: dict, doc: Column) -> Column:
    return _document(literal(filter_), doc)


def _every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _document(filter_: dict, doc: Column) -> Column:
    return _every([_entry(k, x, doc) for k, x in filter_.items()])


def _entry(key: str, x, doc: Column) -> Column:
    if key in ("$and", "$or", "$nor"):
        if not isinstance(x, list):
            return F.lit(key == "$nor")
        tests = [_document(f, doc) for f in x if isinstance(f, dict)]
        return _every(tests) if key == "$and" else _any(tests) if key == "$or" else ~_any(tests)
    if key == "$not":
        return ~_document(x, doc) if isinstance(x, dict) else F.lit(True)
    v = at(doc, key)
    if isinstance(x, dict):
        test = lambda e: _every([_operator(e, op, y) for op, y in x.items()])
        return test(v) if any(_nested(op, y) for op, y in x.items()) else let(v, test)
    return _equal(v, x)


def _nested(op: str, x) -> bool:
    """Whether an operator compares with a document or an array, which needs Python, so that it can't be inside a lambda."""
    wanted = x if op in ("$in", "$nin") and isinstance(x, list) else [x] if op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte") else []
    return any(kind(y) in (Kind.DOCUMENT, Kind.ARRAY) for y in wanted)


def _key(v: Column, x) -> tuple[Column, Column]:
    """Keys of a value and a literal; only documents and arrays need the part that is made in Python."""
    deep = kind(x) in (Kind.DOCUMENT, Kind.ARRAY)
    return sort_key(v, deep), literal_key(x, deep)


def _equal(v: Column, x) -> Column:
    if x is None:
        return sure(F.is_variant_null(v))
    own, wanted = _key(v, x)
    return sure(v.isNotNull() & own.eqNullSafe(wanted))


def _operator(v: Column, op: str, x) -> Column:
    if op in ("$eq", "$ne"):
        return _equal(v, x) if op == "$eq" else ~_equal(v, x)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        own, wanted = _key(v, x)
        test = {"$gt": own > wanted, "$gte": own >= wanted, "$lt": own < wanted, "$lte": own <= wanted}[op]
        return sure(v.isNotNull() & test)
    if op in ("$in", "$nin"):
        some = _any([_equal(v, y) for y in x]) if isinstance(x, list) else F.lit(False)
        return some if op == "$in" else ~some
    if op == "$exists":
        return v.isNotNull() if x is not False else v.isNull()
    if op == "$type":
        return _type(v, x)
    if op == "$regex":
        if not isinstance(x, str) or not valid_pattern(x):
            return F.lit(False)
        return sure((rank(v) == int(Kind.STRING)) & F.try_variant_get(v, "$", "string").rlike(x))
    items = F.try_variant_get(v, "$", "array<variant>")
    is_array = rank(v) == int(Kind.ARRAY)
    if op == "$size":
        return sure(is_array & (F.size(items) == int(x))) if is_number(x) else F.lit(False)
    if op == "$all":
        return sure(is_array & _every([F.exists(items, _is(y)) for y in x])) if isinstance(x, list) else F.lit(False)
    if op == "$elemMatch":
        return sure(is_array & F.exists(items, lambda e: (rank(e) == int(Kind.DOCUMENT)) & _document(x, e))) if isinstance(x, dict) else F.lit(False)
    if op == "$mod":
        if not (isinstance(x, list) and len(x) == 2 and all(map(is_number, x)) and int(x[0])):
            return F.lit(False)
        whole = F.coalesce(F.try_variant_get(v, "$", "bigint"), F.try_variant_get(v, "$", "double").try_cast("bigint"))
        return sure((rank(v) == int(Kind.NUMBER)) & (whole % int(x[0]) == int(x[1])))
    return F.lit(False)


def _is(x):
    return lambda e: _scalar_equal(e, x)


def _scalar_equal(e: Column, x) -> Column:
    """Inside a lambda, where no Python runs: documents and arrays compare by their JSON."""
    if kind(x) in (Kind.DOCUMENT, Kind.ARRAY):
        import json

        return sure(F.to_json(e) == F.lit(json.dumps(x, separators=(",", ":"))))
    return _equal(e, x)


def _type(v: Column, x) -> Column:
    n = TYPE_NAMES.get(x) if isinstance(x, str) else x if isinstance(x, int) and not isinstance(x, bool) else None
    if n is None:
        return F.lit(False)
    r, t = rank(v), F.schema_of_variant(v)
    whole = F.try_variant_get(v, "$", "bigint")
    is_int = whole.between(-(2**31), 2**31 - 1)
    tests = {1: t.isin("DOUBLE", "FLOAT"), 2: r == int(Kind.STRING), 3: r == int(Kind.DOCUMENT), 4: r == int(Kind.ARRAY), 5: r == int(Kind.BINARY), 8: r == int(Kind.BOOL), 9: r == int(Kind.DATE), 10: r == int(Kind.NULL), 16: (t == "BIGINT") & is_int, 18: (t == "BIGINT") & ~is_int, 19: t.startswith("DECIMAL")}
    return sure(tests[n]) if n in tests else F.lit(False)


class DynamicCollection:
    """A DataFrame with a VARIANT column `doc`; other columns are carried."""

    def __init__(self, df: DataFrame, doc: str = "doc"):
        self.df, self.doc = df, doc

    def find(self, filter_: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0, then: list[str] | None = None) -> DataFrame:
        """then: columns that order rows which the sort leaves equal."""
        df = self.df.where(compile_dynamic(filter_, F.col(self.doc))) if filter_ else self.df
        if sort:
            keys = {f"__key{i}": sort_key(at(F.col(self.doc), path)) for i, path in enumerate(sort)}
            df = df.withColumns(keys)
            order = [F.col(k).desc() if is_number(d) and d < 0 else F.col(k).asc() for k, d in zip(keys, sort.values(), strict=True)]
            df = df.orderBy(*order, *(then or []))
        df = df.offset(skip) if skip > 0 else df
        df = df.limit(limit) if limit > 0 else df
        return df.drop(*[c for c in df.columns if c.startswith("__key")])

    def count(self, filter_: dict | None = None) -> int:
        return self.find(filter_).count()

    def distinct(self, path: str) -> DataFrame:
        """One variant `value` of each distinct value at a path; a missing one is left out."""
        v = at(F.col(self.doc), path)
        rows = self.df.select(v.alias("value"), sort_key(v).alias("k")).where("value IS NOT NULL")
        return rows.select("k", F.to_json("value").alias("j")).groupBy("k").agg(F.min("j").alias("j")).select(F.parse_json("j").alias("value"))

    def group_count(self, path: str) -> DataFrame:
        """`_id` (a variant, null where missing or null) and the number of documents."""
        v = at(F.col(self.doc), path)
        keyed = self.df.select(F.when(~F.is_variant_null(v), v).alias("v"))
        return keyed.select(sort_key(F.col("v")).alias("k"), F.to_json("v").alias("j")).groupBy("k").agg(F.min("j").alias("j"), F.count(F.lit(1)).alias("n")).select(F.parse_json("j").alias("_id"), "n")
