"""Drawing from scores: greedy, weighted, top-k, top-k then top-p, expert routing; log-probabilities. Groups are rows of one `by`.

A weighted draw takes the largest of score / temperature plus Gumbel noise of a unit hash, so that it is the same in every run and
needs no running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import top_k
from .ordering import unit_hash


def gumbel(u: Column) -> Column:
    """Standard Gumbel noise of a number in [0, 1)."""
    return -F.log(-F.log(F.greatest(u, F.lit(1e-12))))


def greedy(df: DataFrame, by: list[str], logit: str, tie: str) -> DataFrame:
    """The row of the largest logit of each group; ties to the smaller `tie`."""
    best = df.groupBy(*by).agg(F.min(F.struct((-F.col(logit)).alias("s"), F.col(tie).alias("t"))).alias("b"))
    return best.select(*by, F.col("b.t").alias(tie))


def weighted(df: DataFrame, by: list[str], logit: str, tie: str, seed: str, temperature: float = 1.0) -> DataFrame:
    """One row of each group, drawn with the softmax of logit / temperature."""
    noisy = df.withColumn("noisy", F.round(F.col(logit) / temperature + gumbel(unit_hash(seed, *map(F.col, [*by, tie]))), 9))
    return greedy(noisy, by, "noisy", tie)


def top_k_top_p(df: DataFrame, by: list[str], logit: str, tie: str, k: int, p: float) -> DataFrame:
    """Of the k largest logits of each group those up to the one at which their own softmax, summed from the largest on, reaches p."""
    order = Window.partitionBy(*by).orderBy("rank")
    some = top_k(df, by, logit, tie, k).withColumn("w", F.exp(F.col(logit) - F.max(logit).over(Window.partitionBy(*by))))
    before = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    return some.where(F.lit(True)).withColumn("before", before / F.sum("w").over(Window.partitionBy(*by))).where(F.col("before") < p).select(*df.columns, "rank")


ALGORITHMS = {"greedy": greedy, "weighted": weighted}


def sample(df: DataFrame, algorithm: str, by: list[str], logit: str, tie: str, **more) -> DataFrame:
    """One row of each group by the named algorithm."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no sampling algorithm {algorithm!r}")
    return ALGORITHMS[algorithm](df, by, logit, tie, **more)


def routed(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k experts of each token with `weight`: the softmax over these k."""
    some = top_k(df, by, score, tie, k)
    e = F.exp(F.col(score) - F.max(score).over(Window.partitionBy(*by)))
    return some.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(Window.partitionBy(*by))).drop("e")


def log_probability(df: DataFrame, by: list[str], logit: str) -> DataFrame:
    """Rows with `logp`: the log-softmax of their logit in the group."""
    most = F.max(logit).over(Window.partitionBy(*by))
    total = F.sum(F.exp(F.col(logit) - F.col("most"))).over(Window.partitionBy(*by))
    return df.withColumn("most", most).withColumn("logp", F.col(logit) - F.col("most") - F.log(total)).drop("most")
