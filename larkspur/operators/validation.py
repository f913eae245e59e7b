"""Checks on names and documents before they are written."""

from __future__ import annotations

from ..functions.values import kind, literal

#: Limits that are enforced. Fixed values.
MAX_BATCH = 100_000
MAX_DEPTH = 100
MAX_NAME = 1024
MAX_ARRAY = 1_000_000


def check_collection_name(name: str) -> None:
    if not isinstance(name, str) or not name or name.startswith("system.") or "$" in name or "\0" in name:
        raise ValueError(f"not a collection name: {name!r}")


def check_document(doc: dict) -> None:
    if doc.get("_id", 0) is None or isinstance(doc.get("_id"), list) or type(doc.get("_id")).__name__ == "Regex":
        raise ValueError("_id can't be an array, a pattern or null")
    _check(literal(doc), 0)


def _check(value, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise ValueError("document is nested too deeply")
    if isinstance(value, dict):
        for k, v in value.items():
            if not k or "\0" in k or len(k) > MAX_NAME or not depth and k.startswith("$"):
                raise ValueError(f"not a field name: {k!r}")
            _check(v, depth + 1)
    elif isinstance(value, list):
        if len(value) > MAX_ARRAY:
            raise ValueError("array is too long")
        for v in value:
            _check(v, depth + 1)
    else:
        kind(value)
