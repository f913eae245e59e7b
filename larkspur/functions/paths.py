"""Dotted paths against a schema: which column a path is, and when it is missing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import Kind


@dataclass
class Ref:
    """A value by path. present is None where every row has it, else the rows that do; a null is a value."""

    value: Column
    dtype: T.DataType
    present: Column | None = None


Scope = Callable[[str], Column]


def column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def field(struct: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in struct.fields if f.name == name), None)


def resolve(schema: T.StructType, path: str, scope: Scope = column) -> Ref | None:
    """None if no row can have the path. Through structs, maps and numbered array elements; arrays are not fanned out."""
    first, *rest = path.split(".")
    if field(schema, path) is not None and rest:  # a column whose name has dots
        first, rest = path, []
    if (f := field(schema, first)) is None:
        return None
    ref = Ref(scope(first), f.dataType)
    for part in rest:
        inside = ref.value.isNotNull() if ref.present is None else ref.present & ref.value.isNotNull()
        if isinstance(ref.dtype, T.StructType):
            if (f := field(ref.dtype, part)) is None:
                return None
            ref = Ref(ref.value.getField(part), f.dataType, inside)
        elif isinstance(ref.dtype, T.ArrayType) and part.isdigit():
            ref = Ref(F.get(ref.value, F.lit(int(part))), ref.dtype.elementType, inside & (F.size(ref.value) > int(part)))
        elif isinstance(ref.dtype, T.MapType) and isinstance(ref.dtype.keyType, T.StringType):
            ref = Ref(F.try_element_at(ref.value, F.lit(part)), ref.dtype.valueType, inside & F.map_contains_key(ref.value, F.lit(part)))
        else:
            return None
    return ref


def kind_of(dtype: T.DataType) -> Kind:
    if isinstance(dtype, T.NumericType):
        return Kind.NUMBER
    if isinstance(dtype, T.StringType | T.CharType | T.VarcharType):
        return Kind.STRING
    if isinstance(dtype, T.StructType | T.MapType):
        return Kind.DOCUMENT
    if isinstance(dtype, T.ArrayType):
        return Kind.ARRAY
    if isinstance(dtype, T.BinaryType):
        return Kind.BINARY
    if isinstance(dtype, T.BooleanType):
        return Kind.BOOL
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType | T.DateType):
        return Kind.DATE
    return Kind.NULL


def type_number_of(dtype: T.DataType) -> int:
    if isinstance(dtype, T.IntegerType | T.ShortType | T.ByteType):
        return 16
    if isinstance(dtype, T.LongType):
        return 18
    if isinstance(dtype, T.DecimalType):
        return 19
    return {Kind.NUMBER: 1, Kind.STRING: 2, Kind.DOCUMENT: 3, Kind.ARRAY: 4, Kind.BINARY: 5, Kind.BOOL: 8, Kind.DATE: 9, Kind.NULL: 10}[kind_of(dtype)]


def set_path(old: Column | None, dtype: T.DataType | None, path: list[str], value: Column) -> Column:
    """old with value at the path below it; documents are made on the way, and what is not one is replaced."""
    if not path:
        return value
    name, *rest = path
    if not isinstance(dtype, T.StructType):
        return F.struct(set_path(None, None, rest, value).alias(name))
    f = field(dtype, name)
    inner = set_path(old.getField(name) if f else None, f.dataType if f else None, rest, value)
    others = [old.getField(x.name).alias(x.name) for x in dtype.fields]
    return F.struct(*[inner.alias(name) if x.name == name else c for x, c in zip(dtype.fields, others, strict=True)], *([] if f else [inner.alias(name)]))


def drop_path(old: Column, dtype: T.DataType, path: list[str]) -> Column:
    """old without the field at the path; other than documents stay as they are."""
    if not isinstance(dtype, T.StructType) or (f := field(dtype, path[0])) is None:
        return old
    keep = []
    for x in dtype.fields:
        if x is not f:
            keep.append(old.getField(x.name).alias(x.name))
        elif len(path) > 1:
            keep.append(drop_path(old.getField(x.name), x.dataType, path[1:]).alias(x.name))
    if not keep:
        return F.when(old.isNotNull(), F.struct()).otherwise(F.lit(None))
    return F.when(old.isNotNull(), F.struct(*keep))
