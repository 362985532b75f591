"""Readers and writers by format name; explicit schemas where given."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, format: str, path: str | list[str], schema: str | None = None, header: bool = True) -> DataFrame:
    """parquet, orc, json (lines), json-array, csv, tsv, text or binary files; anything else is an error."""
    kinds = {
        "parquet": ("parquet", {}), "orc": ("orc", {}), "json": ("json", {}), "json-array": ("json", {"multiLine": True}),
        "csv": ("csv", {"header": header}), "tsv": ("csv", {"header": header, "sep": "\t"}), "text": ("text", {}), "binary": ("binaryFile", {}),
    }
    if format not in kinds:
        raise ValueError(f"unknown format {format}")
    name, options = kinds[format]
    reader = spark.read.format(name).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def stream(spark: SparkSession, format: str, path: str, schema: str, files: int = 16) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files).load(path)


def write(df: DataFrame, format: str, path: str, mode: str = "errorifexists", by: list[str] | None = None, **options) -> None:
    writer = df.write.format({"tsv": "csv"}.get(format, format)).mode(mode).options(**({"sep": "\t", "header": True} if format == "tsv" else {}) | options)
    (writer.partitionBy(*by) if by else writer).save(path)


def mixture_weights(spec: str) -> list[tuple[str, float]]:
    """`pattern,weight;pattern,weight` with weights normalised and rounded to four places."""
    pairs = [p.rsplit(",", 1) for p in spec.split(";") if p.strip()]
    total = sum(float(w) for _, w in pairs)
    return [(p.strip(), round(float(w) / total, 4)) for p, w in pairs]


def synthetic(spark: SparkSession, rows: int, length: int, vocabulary: int, seed: int = 0) -> DataFrame:
    """Rows of random tokens with inputs, targets (one ahead), positions and segments."""
    t = F.transform(F.sequence(F.lit(0), F.lit(length)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(vocabulary)).cast("int"))
    rows_ = spark.range(rows).withColumn("t", t)
    return rows_.select("id", F.slice("t", 1, length).alias("inputs"), F.slice("t", 2, length).alias("targets"), F.sequence(F.lit(0), F.lit(length - 1)).alias("positions"), F.array_repeat(F.lit(1), length).alias("segments"))


def placeholder(spark: SparkSession, rows: int, length: int) -> DataFrame:
    return spark.range(rows).select("id", F.array_repeat(F.lit(-1), length).alias("inputs"))


def find_files(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a glob pattern, in any file system that Spark reads; a FileNotFoundError if there are none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern.replace("~", os.path.expanduser("~"), 1) if pattern.startswith("~") else pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(x.getPath().toString() for x in found or [])
    if not names:
        raise FileNotFoundError(pattern)
    return names


def pad_id(pad: int | None, unknown: int | None) -> int:
    """The token id that fills up sequences: the tokenizer's own, else that of unknown tokens, else -1."""
    return next((i for i in (pad, unknown) if i is not None and i >= 0), -1)
