"""Collections: an immutable DataFrame behind find, aggregate and writes that replace it.

A write computes the next version as a plan over the present one. Versions are written as snapshots where the database has
a folder, else checkpointed every few writes, so that plans stay short.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matcher import matches
from ..functions.paths import column, field, resolve
from ..functions.values import ObjectId, literal
from ..plans import pipeline as P
from ..plans.filters import compile_filter
from ..plans.order import sort_columns, with_position
from ..plans.projection import hidden, visible
from ..plans.update import apply_update, upsert_document
from . import validation


class DuplicateKey(ValueError):
    code = 11000


@dataclass
class UpdateResult:
    matched_count: int = 0
    modified_count: int = 0
    upserted_count: int = 0
    upserted_id: object = None


@dataclass
class Index:
    name: str
    keys: dict[str, int]
    unique: bool = False


def index_name(keys: dict[str, int]) -> str:
    return "_".join(f"{k}_{v}" for k, v in keys.items())


class Collection:
    """name and documents. natural: columns whose order is the scan's; without them rows keep the order of the files."""

    def __init__(self, spark: SparkSession, name: str, df: DataFrame | None = None, natural: list[str] | None = None, find=None, keep=None):
        self.spark, self.name, self.natural = spark, name, natural
        self._df = df
        self._find, self._keep = find, keep
        self.indexes = {"_id_": Index("_id_", {"_id": 1}, True)}
        self.lock = threading.RLock()
        self._writes = 0

    # reads

    @property
    def df(self) -> DataFrame:
        return self._df if self._df is not None else self.spark.createDataFrame([], T.StructType([]))

    def source(self) -> P.Source:
        return P.Source(self.df, self.natural)

    def find(self, filter_: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        return P.find(self.source(), filter_, projection, sort, skip, limit)

    def find_one(self, filter_: dict | None = None) -> dict | None:
        row = self.find(filter_, limit=1).first()
        return row.asDict(recursive=True) if row else None

    def find_by_id(self, id_) -> dict | None:
        return self.find_one({"_id": id_})

    def aggregate(self, pipeline: list[dict]) -> DataFrame:
        return P.aggregate(self.source(), pipeline, self._find)

    def distinct(self, path: str, filter_: dict | None = None) -> DataFrame:
        """The distinct values at a path as `value`; a missing one is left out, a null is a value, arrays are not unwound."""
        df = self._where(filter_)
        ref = resolve(df.schema, path)
        if ref is None:
            return self.spark.createDataFrame([], "value string")
        df = df.where(ref.present) if ref.present is not None else df
        return df.select(ref.value.alias("value")).distinct()

    def count(self, filter_: dict | None = None) -> int:
        return self._where(filter_).count()

    def count_frame(self, filter_: dict | None = None) -> DataFrame:
        return self._where(filter_).agg(F.count(F.lit(1)).alias("n"))

    def explain(self, filter_: dict | None = None, sort: dict | None = None, projection: dict | None = None) -> str:
        """The physical plan; the query does not run."""
        plan = self.find(filter_, projection, sort)._jdf.queryExecution()
        return plan.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _where(self, filter_: dict | None) -> DataFrame:
        return self.df.where(compile_filter(filter_, self.df.schema)) if filter_ else self.df

    # writes

    def insert(self, docs: list[dict]) -> list:
        docs = [literal(d) for d in docs]
        if len(docs) > validation.MAX_BATCH:
            raise ValueError("too many documents in a batch")
        for d in docs:
            validation.check_document(d)
        docs = [d if "_id" in d else {"_id": ObjectId(), **d} for d in docs]
        with self.lock:
            ids = [d["_id"] for d in docs]
            if len({(type(i).__name__, repr(i)) for i in ids}) < len(ids):
                raise DuplicateKey("_id")
            if docs:
                self._append(docs)
        return ids

    def insert_one(self, doc: dict):
        return self.insert([doc])[0]

    def insert_frame(self, new: DataFrame) -> None:
        """Appends a DataFrame's rows as documents."""
        with self.lock:
            after = self._union(new)
            self._check_unique(after)
            self._replace(after)

    def _append(self, docs: list[dict]) -> None:
        schema = T.StructType([T.StructField(k, reduce(_widest, [_type(d[k]) for d in docs if k in d])) for k in dict.fromkeys(k for d in docs for k in d)])
        rows = [tuple(_cast(d.get(f.name), f.dataType) for f in schema.fields) for d in docs]
        new = self.spark.createDataFrame(rows, schema)
        after = self._union(new)
        self._check_unique(after)
        self._replace(after)

    def _union(self, new: DataFrame) -> DataFrame:
        if self._df is None or not self._df.columns:
            return new
        old = self._df
        for f in new.schema.fields:
            if (have := field(old.schema, f.name)) is not None and have.dataType != f.dataType:
                wide = _widest(have.dataType, f.dataType)
                old, new = old.withColumn(f.name, column(f.name).cast(wide)), new.withColumn(f.name, column(f.name).cast(wide))
        return old.unionByName(new, allowMissingColumns=True)

    def _check_unique(self, df: DataFrame) -> None:
        for index in self.indexes.values():
            if not index.unique:
                continue
            refs = [resolve(df.schema, k) for k in index.keys]
            if all(r is None for r in refs):
                continue
            keys = [F.lit(None).cast("string") if r is None else r.value for r in refs]
            rows = df.where(refs[0].value.isNotNull()) if index.name == "_id_" else df  # tables that have no _id of their own
            if rows.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
                raise DuplicateKey(index.name)

    def _replace(self, df: DataFrame) -> None:
        self._writes += 1
        if self._keep is not None:
            df = self._keep(self.name, df)
        elif self._writes % 8 == 0 and self.spark.sparkContext.getCheckpointDir():
            df = df.checkpoint()
        self._df = df

    def _first(self, df: DataFrame, match: Column, sort: dict | None = None) -> tuple[DataFrame, object]:
        """df with its position columns, and the position of the first row that matches, if there is one."""
        ordered = with_position(df, self.natural)
        keys = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, _, up in P.sort_keys(ordered, sort or {})]
        row = ordered.where(match).orderBy(*keys, *sort_columns(ordered)).limit(1).select(*hidden(ordered)).collect()
        return ordered, row[0] if row else None

    def _only(self, ordered: DataFrame, row) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(hidden(ordered), row, strict=True)])

    def _apply(self, ordered: DataFrame, when: Column, update: dict) -> tuple[DataFrame, int]:
        after = apply_update(ordered, when, update)
        kept = after.select(*[column(c) for c in visible(after)])
        marked = ordered.withColumn("__when", when)
        before, now = F.struct(*[column(c) for c in visible(ordered)]), [c for c in kept.columns if c in ordered.columns]
        changed = apply_update(marked.withColumn("__before", before), F.col("__when"), update)
        same = reduce(lambda a, b: a & b, [column(c).eqNullSafe(F.col("__before").getField(c)) for c in now], F.lit(len(now) == len(kept.columns)))
        return kept, changed.where(F.col("__when") & ~same).count()

    def update_many(self, filter_: dict, update: dict, upsert: bool = False) -> UpdateResult:
        with self.lock:
            df = self.df
            match = compile_filter(filter_, df.schema)
            n = df.where(match).count()
            if not n:
                return self._upsert(filter_, update) if upsert else UpdateResult()
            after, modified = self._apply(df, match, update)
            self._check_unique(after)
            self._replace(after)
            return UpdateResult(n, modified)

    def update_one(self, filter_: dict, update: dict, upsert: bool = False, sort: dict | None = None) -> UpdateResult:
        with self.lock:
            ordered, row = self._first(self.df, compile_filter(filter_, self.df.schema), sort)
            if row is None:
                return self._upsert(filter_, update) if upsert else UpdateResult()
            after, modified = self._apply(ordered, self._only(ordered, row), update)
            self._check_unique(after)
            self._replace(after)
            return UpdateResult(1, modified)

    def _upsert(self, filter_: dict, update: dict) -> UpdateResult:
        doc = upsert_document(filter_, update)
        rest = {k: v for k, v in update.items() if k != "$setOnInsert"}
        doc = doc if "_id" in doc else {"_id": ObjectId(), **doc}
        schema = T.StructType([T.StructField(k, _type(v)) for k, v in doc.items()])
        new = self.spark.createDataFrame([tuple(_cast(v, f.dataType) for v, f in zip(doc.values(), schema.fields, strict=True))], schema)
        new = apply_update(new, F.lit(True), rest)
        id_ = new.first()["_id"]
        after = self._union(new)
        self._check_unique(after)
        self._replace(after)
        return UpdateResult(0, 0, 1, id_)

    def delete_many(self, filter_: dict) -> int:
        with self.lock:
            match = compile_filter(filter_, self.df.schema)
            n = self.df.where(match).count()
            if n:
                self._replace(self.df.where(~match))
            return n

    def delete_one(self, filter_: dict, sort: dict | None = None) -> int:
        with self.lock:
            ordered, row = self._first(self.df, compile_filter(filter_, self.df.schema), sort)
            if row is None:
                return 0
            self._replace(ordered.where(~self._only(ordered, row)).select(*[column(c) for c in visible(ordered)]))
            return 1

    def replace_one(self, filter_: dict, replacement: dict) -> int:
        """Keeps _id, replaces the rest of the first match; there is no upsert."""
        replacement = {k: v for k, v in literal(replacement).items() if k != "_id"}
        validation.check_document(replacement)
        with self.lock:
            ordered, row = self._first(self.df, compile_filter(filter_, self.df.schema))
            if row is None:
                return 0
            key = ["_id"] if "_id" in ordered.columns else []
            values = {c: replacement.get(c) for c in [*visible(ordered), *replacement] if c not in key}
            after, _ = self._apply(ordered, self._only(ordered, row), {"$set": values})
            self._check_unique(after)
            self._replace(after)
            return 1

    def find_and_modify(self, query: dict, update: dict | None = None, sort: dict | None = None, remove: bool = False, new: bool = False, upsert: bool = False) -> dict | None:
        """Updates or removes the first match by sort; gives the document as it was, or as it is."""
        if remove == (update is not None):
            raise ValueError("either remove or update")
        with self.lock:
            ordered, row = self._first(self.df, compile_filter(query, self.df.schema), sort)
            if row is None:
                if not upsert or remove:
                    return None
                done = self._upsert(query, update)
                return self.find_one({"_id": done.upserted_id}) if new else None
            only = self._only(ordered, row)
            old = ordered.where(only).first().asDict(recursive=True)
            old = {k: v for k, v in old.items() if k in visible(ordered)}
            if remove:
                self._replace(ordered.where(~only).select(*[column(c) for c in visible(ordered)]))
                return old
            after = apply_update(ordered, only, update)
            now = after.where(self._only(ordered, row)).first()
            kept = after.select(*[column(c) for c in visible(after)])
            self._check_unique(kept)
            self._replace(kept)
            now = {k: v for k, v in now.asDict(recursive=True).items() if k in kept.columns}
            return now if new else old

    # indexes are constraints: reads go by the files' statistics

    def create_index(self, keys: dict[str, int], unique: bool = False, name: str | None = None) -> str:
        if not keys:
            raise ValueError("an index needs keys")
        index = Index(name or index_name(keys), dict(keys), unique)
        if index.name not in self.indexes:
            self.indexes[index.name] = index
            try:
                self._check_unique(self.df)
            except DuplicateKey:
                del self.indexes[index.name]
                raise
        return index.name

    def drop_index(self, name: str) -> None:
        if name == "_id_":
            raise ValueError("_id_ can't be dropped")
        if name not in self.indexes:
            raise ValueError(f"no index {name}")
        del self.indexes[name]

    def list_indexes(self) -> list[Index]:
        return [self.indexes[k] for k in sorted(self.indexes)]

    def matches(self, doc: dict, filter_: dict) -> bool:
        return matches(doc, filter_)


def _type(v) -> T.DataType:
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.IntegerType() if -(2**31) <= v < 2**31 else T.LongType()
    if isinstance(v, str):
        return T.StringType()
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, _type(x)) for k, x in v.items()])
    if isinstance(v, list):
        return T.ArrayType(reduce(_widest, map(_type, v), T.NullType()))
    if hasattr(v, "as_tuple"):
        return T.DecimalType(38, min(38, max(0, -v.as_tuple().exponent)))
    if v is None:
        return T.NullType()
    return {float: T.DoubleType(), bytes: T.BinaryType()}.get(type(v)) or (T.TimestampNTZType() if hasattr(v, "hour") else T.DateType())


def _widest(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_widest(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = dict.fromkeys([f.name for f in a.fields] + [f.name for f in b.fields])
        pick = lambda s, n: f.dataType if (f := field(s, n)) else T.NullType()
        return T.StructType([T.StructField(n, _widest(pick(a, n), pick(b, n))) for n in names])
    raise ValueError(f"a typed column can't hold both {a.simpleString()} and {b.simpleString()}; use a dynamic collection")


def _cast(v, dtype: T.DataType):
    if v is None:
        return None
    if isinstance(dtype, T.DoubleType):
        return float(v)
    if isinstance(dtype, T.ArrayType):
        return [_cast(x, dtype.elementType) for x in v]
    if isinstance(dtype, T.StructType):
        return tuple(_cast(v.get(f.name), f.dataType) for f in dtype.fields)
    return str(v) if isinstance(v, str) else v

