"""The filter language over single documents in Python: `matches(doc, filter)`.

For documents on the driver (upserts, checks), and what compiled filters are tested against.
"""

from __future__ import annotations

import math
import re

from .values import MISSING, TYPE_NAMES, compare, get_path, is_number, kind, literal, type_number


def equal(value, wanted) -> bool:
    """Missing equals nothing, a null only a null."""
    return value is not MISSING and kind(value) == kind(wanted) and compare(value, wanted) == 0


def matches(doc: dict, filter_: dict) -> bool:
    return _all(doc, literal(filter_))


def _all(doc: dict, filter_: dict) -> bool:
    return all(_one(doc, k, v) for k, v in filter_.items())


def _one(doc: dict, key: str, wanted) -> bool:
    if key == "$and":
        return isinstance(wanted, list) and all(_all(doc, f) for f in wanted if isinstance(f, dict))
    if key in ("$or", "$nor"):
        some = isinstance(wanted, list) and any(_all(doc, f) for f in wanted if isinstance(f, dict))
        return some if key == "$or" else not some
    if key == "$not":
        return not (isinstance(wanted, dict) and _all(doc, wanted))
    value = get_path(doc, key)
    if isinstance(wanted, dict):
        return all(_operator(value, op, x) for op, x in wanted.items())
    return equal(value, wanted)


def _operator(value, op: str, x) -> bool:
    if op in ("$eq", "$ne"):
        return equal(value, x) == (op == "$eq")
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if value is MISSING:
            return False
        c = compare(value, x)
        return {"$gt": c > 0, "$gte": c >= 0, "$lt": c < 0, "$lte": c <= 0}[op]
    if op in ("$in", "$nin"):
        return (isinstance(x, list) and any(equal(value, v) for v in x)) == (op == "$in")
    if op == "$exists":
        return (value is not MISSING) == (x if isinstance(x, bool) else True)
    if op == "$type":
        n = TYPE_NAMES.get(x) if isinstance(x, str) else x if isinstance(x, int) and not isinstance(x, bool) else None
        return value is not MISSING and n is not None and type_number(value) == n
    if op == "$regex":
        try:
            return isinstance(value, str) and isinstance(x, str) and re.search(x, value) is not None
        except re.error:
            return False
    if op == "$size":
        return isinstance(value, list) and is_number(x) and math.isfinite(x) and len(value) == int(x)
    if op == "$all":
        return isinstance(value, list) and isinstance(x, list) and all(any(equal(e, v) for e in value) for v in x)
    if op == "$elemMatch":
        return isinstance(value, list) and isinstance(x, dict) and any(isinstance(e, dict) and _all(e, x) for e in value)
    if op == "$mod":
        if not (isinstance(x, list) and len(x) == 2 and all(map(is_number, [*x, value])) and all(math.isfinite(n) for n in [*x, value])):
            return False
        n, d, r = int(value), int(x[0]), int(x[1])
        return d != 0 and n - d * int(abs(n) // abs(d)) * (1 if (n < 0) == (d < 0) else -1) == r
    return False
