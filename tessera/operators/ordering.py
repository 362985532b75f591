"""Dense row numbers, hash randomness, splits, shards, samples, repeats and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def unit_hash(seed: str, *key: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and key: the same in every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in key)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def dense_index(df: DataFrame, *order: str, name: str = "idx", by: str | None = None) -> DataFrame:
    """0-based row numbers in the given order, of all rows or of those of each value of `by`: range partitions, written as a
    table, their offsets (a row for each part and value), numbers inside. No task sees all rows. The order should be total."""
    group = [by] if by else []
    part, at, before, of_part, of_group = (_fresh(df, c) for c in ("_part", "_at", "_before", "_of_part", "_of_group"))
    ranged = staged(df.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(part, *group).agg(F.count("*").alias(at))
    earlier = F.sum(at).over(Window.partitionBy(*group).orderBy(part)) - F.col(at)
    offsets = sizes.select(F.col(part).alias(of_part), *(F.col(c).alias(of_group) for c in group), earlier.alias(before))
    inside = F.row_number().over(Window.partitionBy(part, *group).orderBy(*order)) - 1
    same = F.col(part) == F.col(of_part)
    same = same & F.col(by).eqNullSafe(F.col(of_group)) if by else same
    numbered = ranged.withColumn(at, inside).join(offsets if by else F.broadcast(offsets), same)  # without `by` a row for each part
    return numbered.withColumn(name, F.col(at) + F.col(before)).select(*df.columns, name)


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def hash_split(df: DataFrame, seed: str, key: str, test: float = 0.1) -> DataFrame:
    return df.withColumn("split", F.when(unit_hash(seed, F.col(key)) < test, "test").otherwise("train"))


def prefix_split(df: DataFrame, total: int, ratio: float = 0.9) -> DataFrame:
    """First floor(total * ratio) rows are train; df has idx."""
    return df.withColumn("split", F.when(F.col("idx") < int(total * ratio), "train").otherwise("test"))


def contiguous_shards(df: DataFrame, total: int, shards: int) -> DataFrame:
    """Equal slices by idx; the last takes the rest."""
    return df.withColumn("shard", F.least(F.floor(F.col("idx") / max(1, total // shards)), F.lit(shards - 1)).cast("int"))


def round_robin(df: DataFrame, hosts: int) -> DataFrame:
    return df.withColumn("host", F.pmod("idx", F.lit(hosts)).cast("int"))


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """Each row once for each epoch; epochs is a small constant."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def block_shuffle(df: DataFrame, seed: str, key: str, block: int) -> DataFrame:
    """Rows permuted inside blocks of consecutive idx: new position in `pos`."""
    order = Window.partitionBy(F.floor(F.col("idx") / block)).orderBy(unit_hash(seed, F.col(key)), key)
    return df.withColumn("pos", F.floor(F.col("idx") / block) * block + F.row_number().over(order) - 1)


def interleave(df: DataFrame, component: str, order: str, weights: dict[str, float]) -> DataFrame:
    """Deterministic mixture: the k-th row of a component with weight w stands at (k + 0.5) / w; rows of a component without a
    weight stand nowhere (null)."""
    total = sum(weights.values())
    w = F.create_map(*(F.lit(x) for pair in weights.items() for x in (pair[0], pair[1] / total)))
    return dense_index(df, order, name="k", by=component).withColumn("at", (F.col("k") + 0.5) / w[F.col(component)]).drop("k")


def merge_in_order(first: Column, second: Column, seed: str, key: Column) -> Column:
    """Both arrays in one, at random places; the members of the first one keep their order."""
    places = F.array_sort(F.transform(first, lambda x, i: unit_hash(seed, F.lit("a"), key, i)))
    a = F.transform(first, lambda x, i: F.struct(F.get(places, i).alias("u"), F.lit(0).alias("of"), i.alias("i"), x.alias("x")))
    b = F.transform(second, lambda x, i: F.struct(unit_hash(seed, F.lit("b"), key, i).alias("u"), F.lit(1).alias("of"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(F.concat(a, b)), lambda z: z["x"])
