"""Tables as sources and sinks: parquet and JSON files, and atomic snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A document per line; lines that can't be read are left out, `unreadable_lines` gives them."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A document per line as one VARIANT column `doc`: any mixture of kinds. Lines that can't be read are left out."""
    return parsed_lines(spark.read.text(path)).drop("value")


def unreadable_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines, as `value`, that the readers of documents leave out; blank ones don't count."""
    lines = spark.read.text(path)
    return lines.where("try_parse_json(value) IS NULL AND trim(value) <> ''")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """lines (a column `value`) with their documents as `doc`, without those that can't be read."""
    return lines.withColumn("doc", F.expr("try_parse_json(value)")).where("doc IS NOT NULL")


def write_snapshot(df: DataFrame, root: str) -> str:
    """Writes a new snapshot under root and then points the manifest at it; readers see the old or the new one."""
    name = f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    _write_text(df.sparkSession, f"{root}/manifest.json", json.dumps({"snapshot": name}))
    return f"{root}/{name}"


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{json.loads(_read_text(spark, f'{root}/manifest.json'))['snapshot']}")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through Spark's file systems: a temporary file that a rename puts in the old one's place, so that readers find either."""
    temporary, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _fs(spark, path)
    jvm, how = spark._jvm, getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(temporary), fs.makeQualified(target), options)


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()
