"""Sampling cut-offs, evaluation counters and batches of evaluation rows. Windows are per group, never over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k largest scores of each group, with their `rank` from 1; ties to the smaller `tie`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), tie))).where(F.col("rank") <= k)


def nucleus(df: DataFrame, by: list[str], logit: str, tie: str, p: float) -> DataFrame:
    """Rows of each group whose logit is at least the one at which the softmax, summed from the largest on, reaches p."""
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.col(logit).desc(), tie)
    weight = F.exp(F.col(logit) - F.max(logit).over(group))
    some = df.withColumn("_w", weight).withColumn("_at", F.row_number().over(order))
    some = some.withColumn("_upto", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_w").over(group))
    some = some.withColumn("_last", F.least(F.sum((F.col("_upto") < p).cast("int")).over(group) + 1, F.count("*").over(group)))
    cut = F.max(F.when(F.col("_at") == F.col("_last"), F.col(logit))).over(group)
    return some.withColumn("_cut", cut).where(F.col(logit) >= F.col("_cut")).select(df.columns)


def running_loss(df: DataFrame, by: list[str], order: list[str], loss: str, weight: str, epsilon: float = 1e-8) -> DataFrame:
    """`running`: loss per weight over the rows of a group up to each one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(loss).over(w) / (F.sum(weight).over(w) + epsilon))


def masked_mean(df: DataFrame, by: list[str], value: str, mask: str, epsilon: float = 1e-8) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(mask)) / (F.sum(mask) + epsilon)).alias("mean"))


def any_pass(df: DataFrame, question: list[str], flags: list[str]) -> DataFrame:
    """One row: for each flag the percentage of questions of which at least one pass has it."""
    best = df.groupBy(*question).agg(*(F.bool_or(f).alias(f) for f in flags))
    return best.agg(F.count("*").alias("questions"), *((F.avg(F.col(f).cast("int")) * 100).alias(f"{f}_pct") for f in flags))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Count and percentage of each value; the window runs over one aggregated row for each value."""
    g = df.groupBy(by).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def pad_to_batches(df: DataFrame, total: int, batch: int, order: str, weight: str = "weight") -> DataFrame:
    """The rows with weight 1, then copies of the first row with weight 0 until batches are full."""
    real = df.withColumn(weight, F.lit(1))
    missing = -total % batch
    first = df.orderBy(order).limit(1)
    return real.union(first.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(missing)))).drop("_i").withColumn(weight, F.lit(0))) if missing else real


def positional_zip(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of equal dense index side by side."""
    return a.join(b, "idx")
