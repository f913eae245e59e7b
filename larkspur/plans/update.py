"""The update language as conditional columns: operators in document order, each on what the one before left.

A typed column keeps its type where the new value fits it, and widens among numbers where it doesn't; another kind of value
is an error. A column that no operator touches stays as it is in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Ref, column, field, kind_of, resolve, set_path
from ..functions.predicates import constant, equals, ordered
from ..functions.values import Kind, is_number, literal
from .filters import _is, compile_filter
from .projection import schema_of

OPERATORS = ("$set", "$unset", "$inc", "$mul", "$min", "$max", "$rename", "$push", "$pop", "$pull", "$pullAll", "$addToSet", "$currentDate", "$setOnInsert")


def _typed(value: Column, have: T.DataType, want: T.DataType, path: str) -> tuple[Column, T.DataType]:
    if isinstance(have, T.NullType):
        return value.cast(want), want
    if isinstance(want, T.NullType) or have == want:
        return value, have
    if kind_of(have) == kind_of(want) == Kind.NUMBER:
        if isinstance(want, T.FractionalType) and not isinstance(want, T.DecimalType) or isinstance(want, T.LongType) and isinstance(have, T.IntegralType):
            return value.cast(want), want
        return value, have
    if kind_of(have) == kind_of(want):
        return value.cast(want), want
    raise ValueError(f"{path} holds {want.simpleString()}; the update gives {have.simpleString()}")


class Updater:
    def __init__(self, df: DataFrame, when: Column):
        self.df, self.when = df.withColumn("__when", when), F.col("__when")

    def schema(self) -> T.StructType:
        return T.StructType([f for f in schema_of(self.df).fields if f.name != "__when"])

    def ref(self, path: str) -> Ref | None:
        return resolve(self.schema(), path)

    def dtype(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("v")).schema[0].dataType

    def put(self, path: str, value: Column, where: Column | None = None) -> None:
        """Sets path to value in the rows that match, and that `where` holds for."""
        rows, (top, *rest) = self.when if where is None else self.when & where, path.split(".")
        ref, dtype = self.ref(path), self.dtype(value)
        if ref is not None:
            value, dtype = _typed(value, dtype, ref.dtype, path)
        f = field(self.schema(), top)
        old = column(top) if f else None
        new = set_path(old, f.dataType if f else None, rest, value)
        target = self.dtype(new)
        if f is None:
            kept = F.lit(None).cast(target)
        elif not rest or f.dataType == target:
            kept = old.cast(target) if isinstance(f.dataType, T.AtomicType | T.NullType) else old
        else:  # a document that gets a field: rows that don't match get it as null
            kept = F.when(old.isNotNull(), set_path(old, f.dataType, rest, F.lit(None).cast(dtype))) if isinstance(f.dataType, T.StructType) else F.lit(None).cast(target)
        self.df = self.df.withColumn(top, F.when(rows, new).otherwise(kept))

    def unset(self, path: str) -> None:
        if (ref := self.ref(path)) is not None:
            self.put(path, F.lit(None).cast(ref.dtype), ref.present)

    def arithmetic(self, path: str, n, times: bool) -> None:
        if not is_number(n):
            return
        ref = self.ref(path)
        if ref is None:
            self.put(path, F.lit(0.0) if times else constant(n))
            return
        if kind_of(ref.dtype) != Kind.NUMBER:
            raise ValueError(f"{path} is not a number")
        c = F.coalesce(ref.value, F.lit(0).cast(ref.dtype))
        if isinstance(ref.dtype, T.IntegralType):
            wide = c.cast("decimal(38,0)") if isinstance(n, int) else c.cast("double")
            by = F.lit(n).cast("decimal(38,0)") if isinstance(n, int) else F.lit(float(n))
            value = (wide * by if times else wide + by).try_cast("bigint" if isinstance(ref.dtype, T.LongType) else ref.dtype)
            self.put(path, value.cast(ref.dtype))
        elif isinstance(ref.dtype, T.DecimalType):
            by = F.lit(n)
            self.put(path, (c * by if times else c + by).try_cast(ref.dtype))
        else:
            by = F.lit(float(n))
            self.put(path, (c * by if times else c + by).cast(ref.dtype))

    def bound(self, path: str, v, op: str) -> None:
        ref = self.ref(path)
        if ref is None:
            self.put(path, constant(v))
            return
        test = ordered(ref, op, v)
        if ref.present is not None:
            test = test | ~ref.present
        if v is not None and kind_of(ref.dtype) != Kind.NULL and kind_of(ref.dtype) != kind_of(self.dtype(constant(v))):
            raise ValueError(f"{path} holds another kind of value than {v!r}")
        self.put(path, constant(v), test)

    def rename(self, path: str, to) -> None:
        ref = self.ref(path)
        if ref is None or not isinstance(to, str):
            return
        self.put(to, ref.value, ref.present)
        old = self.ref(path)
        self.put(path, F.lit(None).cast(old.dtype), old.present)

    def array(self, path: str) -> Ref | None:
        ref = self.ref(path)
        return ref if ref is not None and isinstance(ref.dtype, T.ArrayType) else None

    def push(self, path: str, x) -> None:
        items = x["$each"] if isinstance(x, dict) and isinstance(x.get("$each"), list) else [x]
        ref = self.ref(path)
        if ref is None:
            self.put(path, constant(items))
            return
        if self.array(path) is None:
            raise ValueError(f"{path} is not an array")
        there = ref.value.isNotNull() if ref.present is None else ref.value.isNotNull() | ~ref.present
        old = F.when(there, F.coalesce(ref.value, F.array().cast(ref.dtype))).otherwise(F.raise_error(F.lit(f"{path} is null, not an array")).cast(ref.dtype))
        self.put(path, F.concat(old, F.array(*[constant(v).cast(ref.dtype.elementType) for v in items]) if items else F.array().cast(ref.dtype)))

    def pop(self, path: str, x) -> None:
        if (ref := self.array(path)) is not None:
            first = is_number(x) and x < 0
            rest = F.slice(ref.value, 2 if first else 1, F.greatest(F.size(ref.value) - 1, F.lit(0)))
            self.put(path, rest, F.size(ref.value) > 0)

    def pull(self, path: str, gone) -> None:
        """gone: element -> whether it goes."""
        if (ref := self.array(path)) is not None:
            self.put(path, F.filter(ref.value, lambda e: ~gone(Ref(e, ref.dtype.elementType))), ref.value.isNotNull())

    def pull_one(self, path: str, x) -> None:
        if not isinstance(x, dict):
            self.pull(path, lambda e: equals(e, x))
            return

        def fits(e: Ref) -> Column:
            if not isinstance(e.dtype, T.StructType):
                return F.lit(False)
            return e.value.isNotNull() & compile_filter(x, e.dtype, lambda name: e.value.getField(name))

        self.pull(path, fits)

    def pull_all(self, path: str, x) -> None:
        if isinstance(x, list):
            self.pull(path, lambda e: _any([equals(e, v) for v in x]))

    def add_to_set(self, path: str, x) -> None:
        items = x["$each"] if isinstance(x, dict) and isinstance(x.get("$each"), list) else [x]
        if self.ref(path) is None:
            distinct: list = []
            for v in items:
                if not any(v == d and type(v) is type(d) for d in distinct):
                    distinct.append(v)
            self.put(path, constant(distinct))
            return
        for v in items:
            if (ref := self.array(path)) is None:
                return
            found = F.exists(ref.value, _is(ref.dtype.elementType, v))
            self.put(path, F.concat(ref.value, F.array(constant(v).cast(ref.dtype.elementType))), ref.value.isNotNull() & ~found)

    def current_date(self, path: str, x) -> None:
        ref = self.ref(path)
        now = F.current_timestamp()
        self.put(path, now.cast(ref.dtype) if ref is not None and kind_of(ref.dtype) == Kind.DATE else now)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def apply_update(df: DataFrame, when: Column, update: dict) -> DataFrame:
    """df with the update applied to the rows that `when` (never null) holds for."""
    up = Updater(df, when)
    for op, fields in literal(update).items():
        if not op.startswith("$"):
            up.put(op, constant(fields))
            continue
        if op not in OPERATORS or op == "$setOnInsert" or not isinstance(fields, dict):
            continue
        for path, x in fields.items():
            {
                "$set": lambda p, v: up.put(p, constant(v)),
                "$unset": lambda p, v: up.unset(p),
                "$inc": lambda p, v: up.arithmetic(p, v, False),
                "$mul": lambda p, v: up.arithmetic(p, v, True),
                "$min": lambda p, v: up.bound(p, v, "$gt"),
                "$max": lambda p, v: up.bound(p, v, "$lt"),
                "$rename": up.rename,
                "$push": up.push,
                "$pop": up.pop,
                "$pull": up.pull_one,
                "$pullAll": up.pull_all,
                "$addToSet": up.add_to_set,
                "$currentDate": up.current_date,
            }[op](path, x)
    return up.df.drop("__when")


def upsert_document(filter_: dict, update: dict) -> dict:
    """What an upsert inserts before the update runs on it: the filter's plain fields, then $setOnInsert's."""
    doc = {k: v for k, v in filter_.items() if not k.startswith("$")}
    for path, x in (update.get("$setOnInsert") or {}).items():
        _put(doc, path.split("."), x)
    return literal(doc)


def _put(doc: dict, path: list[str], x) -> None:
    for part in path[:-1]:
        if not isinstance(doc.get(part), dict):
            doc[part] = {}
        doc = doc[part]
    doc[path[-1]] = x

