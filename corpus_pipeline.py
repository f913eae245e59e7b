"""A corpus from raw documents to packed sequences, in stages that each read their predecessor's table.

quality: documents that fail the rules go, and so do frequent lines. lines: fuzzy copies of lines go, and documents that lose all
their lines. near: of each group of near copies (five-word shingles, 0.8) the document of least id stays. mix: documents are taken as often as
the target weights ask. pack: the mixture's ids in sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import lines, mixing, ngram_join, packing, quality
from larkspur.llm.queries import read, vocabulary
from larkspur.llm.store import saved


def with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """columns of docs, `text` as their text and its length as n_chars."""
    own = {"text": F.col(text), "n_chars": F.length(F.col(text)).cast("long")}
    return docs.select(*[own.get(c, F.col(c)).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(quality.line_frequency(docs).where("kept"), docs.columns, "cleaned")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs, k=lines.PROSE).where((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return with_text(out, docs.columns, "text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    links = ngram_join.jaccard_links(docs, width=5, threshold=(80, 100))
    gone = links.where(F.col("doc_id").isNotNull() & (F.col("component_id") != F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]
#: SQL can't express the keyed draw, the tokenizer or the packing; tests/llm/test_pipeline.py has each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
