"""Writers of the data and metrics pipelines. Each writes whole tables by Spark's committed writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.ordering import hash_split


def write_split(df: DataFrame, path: str, seed: str, key: str, test: float = 0.1) -> dict[str, int]:
    """Rows into path/split=train and path/split=test by a hash of the key; returns the counts."""
    hash_split(df, seed, key, test).write.partitionBy("split").parquet(path)
    return {r["split"]: r["count"] for r in df.sparkSession.read.parquet(path).groupBy("split").count().collect()}


def write_batches(df: DataFrame, path: str, idx: str, rows: int) -> None:
    """Rows in folders of `rows` consecutive numbers each (batch=0, 1, ...)."""
    df.withColumn("batch", F.floor(F.col(idx) / rows)).write.partitionBy("batch").mode("append").parquet(path)


def write_texts(df: DataFrame, path: str, text: str = "text", mode: str = "errorifexists") -> None:
    """One stripped text column without empty texts, zstd-compressed."""
    df.select(strip(F.col(text)).alias("text")).where("text <> ''").write.mode(mode).option("compression", "zstd").parquet(path)


def write_metrics(df: DataFrame, path: str, run: str, period: int) -> None:
    """Metrics rows (step, ...) as JSON lines in folders by the first step of their period; a table that has step 0 begins anew."""
    start = df.where("step = 0").limit(1).count()
    rows = df.select(*(F.col(c).cast("double").alias(c) if c != "step" else F.col(c) for c in df.columns), F.lit(run).alias("run_name"))
    rows = rows.withColumn("first_step", F.floor(F.col("step") / period) * period)
    rows.write.mode("overwrite" if start else "append").partitionBy("first_step").json(path)


def write_dimensions(df: DataFrame, path: str, dimensions: list[str]) -> None:
    """JSON lines of {metrics: {...}, dimensions: {...}}, one for each configuration."""
    rest = [c for c in df.columns if c not in dimensions]
    df.select(F.struct(*rest).alias("metrics"), F.struct(*dimensions).alias("dimensions")).write.json(path)


def copied(spark: SparkSession, source: str, target: str, force: bool = False) -> bool:
    """Copy a table; one that is there stays unless force. Returns whether it wrote."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(target)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) and not force:
        return False
    spark.read.parquet(source).write.mode("overwrite").parquet(target)
    return True


def folder_bytes(spark: SparkSession, path: str, pattern: str = "*") -> int:
    """Bytes of the files of a folder, below it too, whose names match."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.agg(F.sum("length")).first()[0] or 0


def manifest(df: DataFrame, shard: str) -> DataFrame:
    """Rows of each shard, and all of them, as a dataset's description has them."""
    lengths = df.groupBy(shard).agg(F.count("*").alias("length"))
    return lengths.withColumn("total", F.sum("length").over(Window.partitionBy(F.lit(0))))
