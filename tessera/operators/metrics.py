"""Training-metric analytics and evaluation rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Average, median and sum of the newest n rows of each group that have the value."""
    newest = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    kept = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
    return kept.groupBy(*by).agg(F.avg(value).alias("avg_v"), F.median(value).alias("median_v"), F.sum(value).alias("sum_v"), F.count("*").alias("n"))


def utilisation(tflops: Column, device: Column, peaks: dict[str, float]) -> Column:
    """Share of a device's peak; null for unknown devices."""
    return tflops / F.create_map(*(F.lit(x) for kv in peaks.items() for x in kv))[device]


def group_advantage(df: DataFrame, by: list[str], reward: str, epsilon: float = 1e-4) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + epsilon))


def accuracy_levels(df: DataFrame, levels: list[str], flag: str) -> DataFrame:
    """Accuracy overall and for each level's values: (level, name, n, accuracy)."""
    parts = [df.select(F.lit("overall").alias("level"), F.lit("all").alias("name"), flag)]
    parts += [df.select(F.lit(c).alias("level"), F.col(c).alias("name"), flag) for c in levels]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("level", "name").agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("accuracy"))


def against_baseline(df: DataFrame, keys: list[str], test: str, base: str, value: str) -> DataFrame:
    """Percent difference of each test to the base test of the same keys, as text; NA without one."""
    mine = df.where(F.col(test) == base).groupBy(*keys).agg(F.first(value).alias("_base"))
    pct = F.format_string("%.2f%%", (F.try_divide(F.col(value), F.col("_base")) - 1) * 100)
    return df.join(mine, keys, "left").withColumn("pct", F.coalesce(pct, F.lit("NA"))).drop("_base")


def parse_log(line: Column) -> list[Column]:
    """step, seconds, tflops, tokens per second, weights and loss of a step's log line; nulls elsewhere."""
    def field(name: str, kind: str, out: str) -> Column:
        found = F.regexp_extract(line, name + r": ([-+0-9.eE]+)", 1)
        return F.nullif(found, F.lit("")).try_cast(kind).alias(out)

    return [field("completed step", "long", "step"), field("seconds", "double", "seconds"), field("TFLOP/s/device", "double", "tflops"), field("Tokens/s/device", "double", "tokens_s"), field("total_weights", "double", "weights"), field("loss", "double", "loss")]


def learning_rate(step: Column, peak: float, warmup: int, total: int, final: float = 0.1) -> Column:
    """Linear warm-up, cosine to final * peak, then zero."""
    share = (step - warmup) / (total - warmup)
    cosine = peak * (final + (1 - final) * 0.5 * (F.cos(F.lit(3.141592653589793) * share) + 1))
    return F.when(step < warmup, peak * step / warmup).when(step < total, cosine).otherwise(0.0)


def ramp_up(start: int, end: int, increment: int, samples: int, steps: int) -> list[tuple[int, int]]:
    """(step, batch size): the size grows by `increment` after each share of `samples`."""
    rises = max(1, (end - start) // increment)
    per_rise, size, seen, out = samples / rises, start, 0, []
    for step in range(steps):
        out.append((step, size))
        seen += size
        while size < end and seen >= per_rise:
            seen, size = seen - per_rise, min(end, size + increment)
    return out


def decoder_size(layers: Column, dim: Column, vocabulary: int, length: int) -> tuple[Column, Column]:
    """(parameters, training operations of one sequence) of a decoder whose feed-forward part has three matrices of four times
    its width: 6 operations for each weight and token, 12 for each pair of tokens and unit of width."""
    weights = dim * dim * 4 + dim * dim * 12
    parameters = layers * (weights + dim * 2) + dim * (2 * vocabulary)
    return parameters, (layers * weights + dim * vocabulary) * (6 * length) + layers * dim * (12 * length * length)


def schedule(tokens: Column, per_step: int, warmup: float, every: int) -> tuple[Column, Column, Column]:
    """(steps, warm-up steps, steps between evaluations) for a number of tokens; the last two are 1 at least."""
    steps = F.ceil(tokens / per_step)
    return steps, F.greatest(F.lit(1).cast("long"), F.ceil(steps * warmup)), F.lit(max(1, -(-every // per_step))).cast("long")


def exported_name(metric: Column, names: dict[str, str]) -> Column:
    """The name under which a metric is exported; its own where none is given."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[metric], metric)


def run_summary(df: DataFrame, by: list[str], order: list[str], value: str, steps: int) -> DataFrame:
    """Average, median and sum over the newest steps - 10 rows with the value (all, if that isn't positive)."""
    return last_n(df, by, order, value, steps - 10 if steps > 10 else 1 << 62)
