"""Token sequences: cut, pad, shift, mask, pack, batch. Arrays are column expressions; blocks pack in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pad_or_trim(x: Column, length: int, pad: int = 0) -> Column:
    return F.slice(F.concat(x, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(x)))), 1, length)


def chunks(x: Column, length: int) -> Column:
    """Pieces of an array; none for an empty one."""
    n = F.ceil(F.size(x) / length).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * length + 1, F.lit(length)))).otherwise(F.array().cast("array<array<string>>"))


def segmentation(x: Column, pad: int = 0) -> Column:
    return F.transform(x, lambda t: (t != pad).cast("int"))


def shift_left(x: Column, fill: int) -> Column:
    return F.concat(F.slice(x, F.lit(2), F.greatest(F.lit(0), F.size(x) - 1)), F.array(F.lit(fill)))


def shift_right(x: Column, fill: int = 0) -> Column:
    return F.concat(F.array(F.lit(fill)), F.slice(x, F.lit(1), F.greatest(F.lit(0), F.size(x) - 1)))


def mask_ignored(segments: Column, targets: Column, ignored: list[int]) -> Column:
    return F.zip_with(segments, targets, lambda s, t: F.when(t.isin(ignored), 0).otherwise(s))


def prompt_mask(messages: Column, is_prompt: Column, unknown: int) -> Column:
    """Targets of a conversation: prompt tokens become `unknown`."""
    return F.flatten(F.zip_with(messages, is_prompt, lambda m, p: F.when(p, F.transform(m, lambda t: F.lit(unknown))).otherwise(m)))


def greedy_pack(df: DataFrame, length: int, n: str = "n") -> DataFrame:
    """Bins of a greedy packer: rows (idx, n) in blocks of `length` rows go to the open bin while it fits, else a new one
    opens; a block ends its bin. Blocks are independent. Adds block, bin."""
    block = df.withColumn("block", F.floor(F.col("idx") / length)).withColumn("_n", F.least(F.col(n), F.lit(length)).cast("int"))
    rows = block.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("idx", "_n", *[c for c in df.columns if c != "idx"]))).alias("r"))
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).alias("bin"), F.array().cast("array<int>").alias("bins"))
    step = lambda a, x: F.when((a["bin"] >= 0) & (a["used"] + x["_n"] <= length), F.struct((a["used"] + x["_n"]).alias("used"), a["bin"].alias("bin"), F.concat(a["bins"], F.array(a["bin"])).alias("bins"))).otherwise(F.struct(x["_n"].alias("used"), (a["bin"] + 1).alias("bin"), F.concat(a["bins"], F.array(a["bin"] + 1)).alias("bins")))
    packed = rows.withColumn("p", F.aggregate("r", start, step)["bins"]).select("block", F.explode(F.arrays_zip(F.col("r"), F.col("p"))).alias("z"))
    return packed.select("block", "z.r.*", F.col("z.p").alias("bin")).drop("_n")


def token_offsets(df: DataFrame, n: str, order: str = "idx", block: int = 4096) -> DataFrame:
    """`offset`: tokens of all rows before, by sums of blocks of rows and running sums inside; no task sees all rows."""
    blocked = df.withColumn("_b", F.floor(F.col(order) / block))
    sums = blocked.groupBy("_b").agg(F.sum(n).alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))
    inside = F.sum(n).over(Window.partitionBy("_b").orderBy(order)) - F.col(n)
    return blocked.withColumn("_i", inside).join(before, "_b").withColumn("offset", F.col("_i") + F.col("_before")).drop("_b", "_i", "_before")


def concat_then_split(df: DataFrame, length: int, n: str = "n") -> DataFrame:
    """(chunk, document, tokens in it) when all rows' tokens are laid end to end and cut every `length`. df has offset."""
    first, last = F.floor(F.col("offset") / length), F.floor((F.col("offset") + F.col(n) - 1) / length)
    out = df.where(F.col(n) > 0).withColumn("chunk", F.explode(F.sequence(first, last)))
    return out.withColumn("tokens", F.least((F.col("chunk") + 1) * length, F.col("offset") + F.col(n)) - F.greatest(F.col("chunk") * length, F.col("offset")))


def bucket_of(n: Column, lengths: list[int]) -> Column:
    """Smallest bucket that holds n, else the largest."""
    return F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda b: b >= n)), F.lit(max(lengths)))


def balanced_order(x: Column, groups: int) -> Column:
    """The sequence in 2 * groups parts, in the order 0, last, 1, last but one, ..."""
    size = (F.size(x) / (2 * groups)).cast("int")
    order = [j for i in range(groups) for j in (i, 2 * groups - 1 - i)]
    return F.concat(*(F.slice(x, F.lit(j) * size + 1, size) for j in order))
