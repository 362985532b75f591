"""Fixed-count row windows and neighbours in time. Inputs have a dense idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_rows(df: DataFrame, total: int, size: int, stride: int | None = None) -> DataFrame:
    """One row for each (window, member): windows [w * stride, w * stride + size), trailing rows out; with fewer rows than a
    window, one window goes round."""
    stride = stride or size
    count = max(1, (total - size) // stride + 1)
    if total < size:
        times = F.floor((size - 1 - F.col("idx")) / total) + 1
        return df.withColumn("w", F.lit(0).cast("long")).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).withColumn("at", F.col("idx") + F.col("_r") * total).drop("_r")
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("idx") - size + 1) / stride))
    high = F.least(F.floor(F.col("idx") / stride), F.lit(count - 1).cast("long"))
    hits = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("w", F.explode(hits)).withColumn("at", F.col("idx") - F.col("w") * stride)


def lag_seconds(seconds: str, order: list[str], by: list[str] | None = None) -> Column:
    """Whole seconds since the row before; never negative; null on the first row."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    delta = F.col(seconds) - F.lag(seconds).over(w)
    return F.when(delta.isNotNull(), F.greatest(F.lit(0).cast("long"), delta))


def last_marked(value: str, marked: Column, order: list[str], by: list[str]) -> Column:
    """Value of the last earlier row that is marked."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(marked, F.col(value)), ignorenulls=True).over(w)


def moving_average(value: str, n: int, order: list[str], by: list[str]) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0))
