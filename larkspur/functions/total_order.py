"""The total order over VARIANT values as columns that can be compared, sorted and grouped by.

Scalars become a struct of rank, number and text. Arrays and documents get a key of bytes whose order is theirs, made in Arrow
batches and only where such values are.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Kind, kind, literal


def encode(value) -> bytes:
    """Bytes that compare as the values do: numbers as order-preserving doubles, then the digits that a double leaves out."""
    k = kind(value)
    out = bytes([int(k)])
    if k == Kind.NUMBER:
        number = float(value) + 0.0 if abs(value) < 2**1023 else float("inf") * (1 if value > 0 else -1)
        bits = struct.unpack(">Q", struct.pack(">d", number or 0.0))[0]
        bits = bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63)
        rest = int(value) - int(number) if isinstance(value, int) and abs(value) >= 2**53 and abs(number) != float("inf") else 0
        return out + struct.pack(">QQ", bits, (rest + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)
    if k == Kind.STRING:
        return out + value.encode().replace(b"\0", b"\0\xff") + b"\0\0"
    if k == Kind.BOOL:
        return out + bytes([value])
    if k == Kind.ARRAY:
        return out + b"".join(map(encode, value)) + b"\0"
    if k == Kind.DOCUMENT:
        return out + struct.pack(">I", len(value)) + b"".join(encode(x) + encode(v) for x, v in value.items())
    return out


def _encoded(json_text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else encode(json.loads(t)))

    return F.pandas_udf(run, "binary")(json_text)


def let(x: Column, f) -> Column:
    """f(x) with x computed once a row: a lambda's argument is never merged into the places that use it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def rank(v: Column) -> Column:
    """The rank of a variant's kind; -1 where it is missing."""

    def of(t: Column) -> Column:
        out = F.when(t.isNull(), -1).when(t == "VOID", int(Kind.NULL))
        for prefix, k in (("OBJECT", Kind.DOCUMENT), ("ARRAY", Kind.ARRAY), ("STRING", Kind.STRING), ("BOOLEAN", Kind.BOOL), ("BINARY", Kind.BINARY), ("DATE", Kind.DATE), ("TIMESTAMP", Kind.DATE)):
            out = out.when(t.startswith(prefix), int(k))
        return out.otherwise(int(Kind.NUMBER)).cast("int")

    return let(F.schema_of_variant(v), of)


def _flat_key(v: Column, r: Column) -> Column:
    """A scalar's rank, number, exact number and text."""
    is_number = r == int(Kind.NUMBER)
    number = F.when(is_number, F.try_variant_get(v, "$", "double")).when(r == int(Kind.DATE), F.unix_micros(F.try_variant_get(v, "$", "timestamp")).cast("double")).when(r == int(Kind.BOOL), F.try_variant_get(v, "$", "boolean").cast("double"))
    exact = F.when(is_number, F.try_variant_get(v, "$", "decimal(38,10)"))
    text = F.when(r == int(Kind.STRING), F.try_variant_get(v, "$", "string"))
    return F.struct(r.alias("rank"), number.alias("number"), exact.alias("exact"), text.alias("text"))


def sort_key(v: Column, deep: bool = True) -> Column:
    """A struct whose ascending order is the total order, missing values first. Without deep no Python runs, and documents are
    equal to each other, and arrays too."""
    flat = let(v, lambda x: let(rank(x), lambda r: _flat_key(x, r)))
    if not deep:
        return flat
    nested = let(v, lambda x: F.when(rank(x).isin(int(Kind.DOCUMENT), int(Kind.ARRAY)), F.to_json(x)))
    return F.struct(flat.alias("flat"), _encoded(nested).alias("deep"))


def literal_key(value, deep: bool = True) -> Column:
    """The same struct for a literal."""
    value = literal(value)
    k = kind(value)
    if k == Kind.DATE:
        number = F.unix_micros(F.lit(value).cast("timestamp")).cast("double")
    else:
        number = F.lit(float(value) if k in (Kind.NUMBER, Kind.BOOL) else None).cast("double")
    exact = str(value) if k == Kind.NUMBER and abs(value) < 10**28 else None
    parts = [F.lit(int(k)).alias("rank"), number.alias("number"), F.lit(exact).cast("decimal(38,10)").alias("exact"), F.lit(str(value) if k == Kind.STRING else None).cast("string").alias("text")]
    if not deep:
        return F.struct(*parts)
    return F.struct(F.struct(*parts).alias("flat"), F.lit(bytearray(encode(value)) if k in (Kind.DOCUMENT, Kind.ARRAY) else None).cast("binary").alias("deep"))
