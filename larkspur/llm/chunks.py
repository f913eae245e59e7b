"""Chunks: groups of documents of about equal size, the unit in which a task sums up, asks and gets answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_chars(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.length(text_col))).first()[0] or 0


def with_chunks(docs: DataFrame, chunk_chars: int, id_col: str = "doc_id", text_col: str = "text", total: int | None = None) -> DataFrame:
    """docs with `chunk`, a hash of id and text, so that each has about chunk_chars characters.

    Which chunk a row is in depends on the row alone, so every pass deals alike; no key, host or group of copies shares one.
    """
    n = max(1, -(-(total_chars(docs, text_col) if total is None else total) // chunk_chars))
    return docs.withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)), F.lit(n)))
