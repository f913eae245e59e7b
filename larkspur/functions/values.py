"""Document values: their kinds, literals and total order, in Python.

Kinds rank as minKey < null < number < string < document < array < binary < objectId < bool < date < timestamp
< regex < ... < maxKey; values of different kinds compare by rank alone.
"""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import functools
import itertools
import math
import os
import re
import time
from enum import IntEnum


class Kind(IntEnum):
    MIN_KEY = 0
    NULL = 1
    NUMBER = 2
    STRING = 3
    DOCUMENT = 4
    ARRAY = 5
    BINARY = 6
    OBJECT_ID = 7
    BOOL = 8
    DATE = 9
    TIMESTAMP = 10
    REGEX = 11
    CODE = 13
    UNDEFINED = 14
    MAX_KEY = 15


class _Single:
    def __init__(self, name: str, kind: Kind):
        self.name, self.kind = name, kind

    def __repr__(self) -> str:
        return self.name

    def __reduce__(self):
        return self.name


MISSING = _Single("MISSING", Kind.NULL)
MinKey = _Single("MinKey", Kind.MIN_KEY)
MaxKey = _Single("MaxKey", Kind.MAX_KEY)


class ObjectId(str):
    """Twelve bytes as 24 hexadecimal digits: seconds, five random bytes of the process, a counter."""

    _random = os.urandom(5).hex()
    _counter = itertools.count(int.from_bytes(os.urandom(3), "big"))

    def __new__(cls, value: str | None = None):
        if value is None:
            value = f"{int(time.time()):08x}{cls._random}{next(cls._counter) & 0xFFFFFF:06x}"
        if not re.fullmatch("[0-9a-fA-F]{24}", value):
            raise ValueError(f"not an object id: {value!r}")
        return super().__new__(cls, value.lower())


class Timestamp(tuple):
    def __new__(cls, t: int, i: int):
        return super().__new__(cls, (t, i))


class Regex:
    def __init__(self, pattern: str, options: str = ""):
        self.pattern, self.options = pattern, "".join(sorted(options))


#: Numbers and names by which values are asked for their type. Fixed values.
TYPE_NAMES = {
    "double": 1,
    "string": 2,
    "object": 3,
    "array": 4,
    "binData": 5,
    "undefined": 6,
    "objectId": 7,
    "bool": 8,
    "date": 9,
    "null": 10,
    "regex": 11,
    "dbPointer": 12,
    "javascript": 13,
    "symbol": 14,
    "javascriptWithScope": 15,
    "int": 16,
    "timestamp": 17,
    "long": 18,
    "decimal": 19,
    "minKey": -1,
    "maxKey": 127,
}


def is_number(x) -> bool:
    return isinstance(x, int | float | decimal.Decimal) and not isinstance(x, bool)


def kind(x) -> Kind:
    if x is None:
        return Kind.NULL
    if isinstance(x, _Single):
        return x.kind
    if isinstance(x, bool):
        return Kind.BOOL
    if is_number(x):
        return Kind.NUMBER
    if isinstance(x, ObjectId):
        return Kind.OBJECT_ID
    if isinstance(x, str):
        return Kind.STRING
    if isinstance(x, dict):
        return Kind.DOCUMENT
    if isinstance(x, Timestamp):
        return Kind.TIMESTAMP
    if isinstance(x, list | tuple):
        return Kind.ARRAY
    if isinstance(x, bytes | bytearray):
        return Kind.BINARY
    if isinstance(x, dt.date):
        return Kind.DATE
    if isinstance(x, Regex):
        return Kind.REGEX
    raise TypeError(f"not a document value: {x!r}")


def type_number(x) -> int:
    """The type number that `$type` asks for; integers are int32 if they fit."""
    if is_number(x):
        if isinstance(x, int):
            return 16 if -(2**31) <= x < 2**31 else 18
        return 1 if isinstance(x, float) else 19
    return {Kind.NULL: 10, Kind.STRING: 2, Kind.DOCUMENT: 3, Kind.ARRAY: 4, Kind.BINARY: 5, Kind.OBJECT_ID: 7, Kind.BOOL: 8, Kind.DATE: 9, Kind.TIMESTAMP: 17, Kind.REGEX: 11, Kind.MIN_KEY: -1, Kind.MAX_KEY: 127}[kind(x)]


def _moment(x) -> dt.datetime:
    x = x if isinstance(x, dt.datetime) else dt.datetime(x.year, x.month, x.day)
    return x.astimezone(dt.UTC).replace(tzinfo=None) if x.tzinfo else x


def _order(a, b) -> int:
    return (a > b) - (a < b)


def compare(a, b) -> int:
    """-1, 0 or 1 by the total order over all values."""
    ka, kb = kind(a), kind(b)
    if ka != kb:
        return _order(ka, kb)
    if ka == Kind.NUMBER:
        na, nb = (isinstance(x, float) and math.isnan(x) for x in (a, b))
        return _order(na, nb) if na or nb else _order(a, b)
    if ka == Kind.DOCUMENT:
        if len(a) != len(b):
            return _order(len(a), len(b))
        for (k, x), (m, y) in zip(a.items(), b.items(), strict=True):
            if c := _order(k, m) or compare(x, y):
                return c
        return 0
    if ka == Kind.ARRAY:
        for x, y in zip(a, b, strict=False):
            if c := compare(x, y):
                return c
        return _order(len(a), len(b))
    if ka == Kind.BINARY:
        return _order((len(a), bytes(a)), (len(b), bytes(b)))
    if ka == Kind.DATE:
        return _order(_moment(a), _moment(b))
    if ka == Kind.REGEX:
        return _order((a.pattern, a.options), (b.pattern, b.options))
    if ka in (Kind.NULL, Kind.MIN_KEY, Kind.MAX_KEY):
        return 0
    return _order(a, b)


sort_key = functools.cmp_to_key(compare)


def literal(x):
    """A JSON value with extended forms ({"$date": ...}, {"$oid": ...}, {"$numberLong": ...}) as a value."""
    if isinstance(x, list | tuple) and not isinstance(x, Timestamp):
        return [literal(v) for v in x]
    if not isinstance(x, dict):
        return x
    if len(x) == 1:
        (k, v), = x.items()
        if k == "$date":
            if isinstance(v, dict):
                v = literal(v)
            return v if isinstance(v, dt.date) else dt.datetime.fromtimestamp(v / 1000, dt.UTC).replace(tzinfo=None) if is_number(v) else _moment(dt.datetime.fromisoformat(v.replace("Z", "+00:00")))
        if k == "$oid":
            return ObjectId(v)
        if k in ("$numberLong", "$numberInt"):
            return int(v)
        if k == "$numberDouble":
            return float(v.replace("Infinity", "inf")) if isinstance(v, str) else float(v)
        if k == "$numberDecimal":
            d = decimal.Decimal(v)
            if not d.is_finite() or len(d.as_tuple().digits) > 38 or abs(d.as_tuple().exponent) > 38:
                raise ValueError(f"decimal out of range: {v}")
            return d
        if k == "$binary":
            return base64.b64decode(v["base64"] if isinstance(v, dict) else v)
        if k == "$timestamp":
            return Timestamp(v["t"], v["i"])
        if k == "$regularExpression":
            return Regex(v["pattern"], v.get("options", ""))
        if k in ("$minKey", "$maxKey"):
            return MinKey if k == "$minKey" else MaxKey
    return {k: literal(v) for k, v in x.items()}


def get_path(doc, path: str):
    """The value at a dotted path, through documents and numbered array elements; MISSING if there is none."""
    for part in path.split("."):
        if isinstance(doc, dict) and part in doc:
            doc = doc[part]
        elif isinstance(doc, list | tuple) and part.isdigit() and int(part) < len(doc):
            doc = doc[int(part)]
        else:
            return MISSING
    return doc
