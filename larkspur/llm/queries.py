"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, lattice, licences, lines, mixing, ngram_join, packing, quality, substring, toxicity
from .oracle import ORACLE_SQL
from .store import saved


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.duplicate_lines(docs).select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.with_sizes(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    mixed = mixing.mix(saved(sized, "sized"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.col("mix_shards").alias("shards"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary())


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_licences_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_all(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.line_frequency(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines", "words_left")


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


QUERIES = {"op8_licences": op8_licences, "op4_lines": op4_lines, "op1_fingerprints": op1_fingerprints, "op5_ngram_join": op5_ngram_join, "op2_substring": op2_substring, "op10_lattice": op10_lattice, "op3_toxicity": op3_toxicity, "op9_quality": op9_quality, "op6_mixing": op6_mixing, "op7_packing": op7_packing, "op8_licences_anywhere": op8_licences_anywhere}

__all__ = ["ORACLE_SQL", "QUERIES", "read", "vocabulary"]
