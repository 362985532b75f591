"""Packing of token sequences into fixed lengths, with positions and segments. Rows carry a dense `idx`; blocks of consecutive rows
pack independently, so no task sees more than a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import concat_then_split, greedy_pack, pad_or_trim


def positions(v: Column) -> Column:
    """0, 1, 2, ... for the elements of an array."""
    return F.transform(v, lambda x, i: i)


def laid_out(parts: Column, length: int, pad: int = 0, first_segment: int = 1, step: int = 1) -> tuple[Column, Column, Column]:
    """(values, positions, segments) of arrays laid end to end and filled to `length`: positions begin anew in each, segments
    number them; behind them stand pads, positions 0 and segments 0."""
    whole = F.flatten(parts)
    at = F.flatten(F.transform(parts, positions))
    of = F.flatten(F.transform(parts, lambda v, i: F.transform(v, lambda x: i * step + first_segment)))
    return pad_or_trim(whole, length, pad), pad_or_trim(at, length), pad_or_trim(of, length)


def pack_greedily(df: DataFrame, values: str, length: int, pad: int = 0) -> DataFrame:
    """(block, bin, values, positions, segments): rows cut to `length` go to the open bin of their block while it has room."""
    cut = df.select("idx", F.slice(values, 1, length).alias("v"))
    binned = greedy_pack(cut.withColumn("n", F.size("v")), length)
    g = binned.groupBy("block", "bin").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("r"))
    v, at, of = laid_out(F.transform("r", lambda x: x["v"]), length, pad)
    return g.select("block", "bin", v.alias("values"), at.alias("positions"), of.alias("segments"))


def first_fit(df: DataFrame, length: int, n: str = "n") -> DataFrame:
    """Rows (idx, n) with block and bin: each goes to the first bin of its block with room, else a new one opens. A block has
    `length` rows; n is at most `length`."""
    rows = df.withColumn("block", F.floor(F.col("idx") / length)).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("idx", F.col(n).cast("int").alias("n")))).alias("r"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("bins"))

    def step(a: Column, x: Column) -> Column:
        at = F.array_position(F.transform(a["used"], lambda u: u + x["n"] <= length), True).cast("int")
        more = F.transform(a["used"], lambda u, j: F.when(j + 1 == at, u + x["n"]).otherwise(u))
        used = F.when(at > 0, more).otherwise(F.concat(a["used"], F.array(x["n"])))
        return F.struct(used.alias("used"), F.concat(a["bins"], F.array(F.when(at > 0, at - 1).otherwise(F.size(a["used"])))).alias("bins"))

    packed = rows.withColumn("p", F.aggregate("r", start, step)["bins"])
    return packed.select("block", F.explode(F.arrays_zip(F.col("r"), F.col("p"))).alias("z")).select("block", "z.r.idx", "z.r.n", F.col("z.p").alias("bin"))


def concat_values(df: DataFrame, values: str, length: int, bos: int | None = None) -> DataFrame:
    """(chunk, values): all rows' values end to end, cut every `length`; with bos, each chunk's first value becomes bos. df has
    `offset` (values of all rows before)."""
    cut = concat_then_split(df.withColumn("n", F.size(values).cast("long")), length)
    start = F.greatest(F.col("chunk") * length - F.col("offset"), F.lit(0)).cast("int")
    piece = cut.select("chunk", "offset", F.slice(values, start + 1, F.col("tokens").cast("int")).alias("v"))
    g = piece.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("offset", "v"))).alias("r"))
    whole = F.flatten(F.transform("r", lambda x: x["v"]))
    g = g.select("chunk", whole.alias("values"))
    return g if bos is None else g.withColumn("values", F.concat(F.array(F.lit(bos)), F.slice("values", F.lit(2), F.size("values") - 1)))


def concat_groups(df: DataFrame, values: str, group: int) -> DataFrame:
    """(group, values): rows of `group` consecutive idx end to end, without zeros."""
    g = df.groupBy(F.floor(F.col("idx") / group).alias("group")).agg(F.array_sort(F.collect_list(F.struct("idx", F.col(values).alias("v")))).alias("r"))
    return g.select("group", F.filter(F.flatten(F.transform("r", lambda x: x["v"])), lambda t: t != 0).alias("values"))


def next_tokens(targets: Column, eos: int = 1, pad: int = 0) -> tuple[Column, Column, Column]:
    """(inputs, targets shifted by one with eos behind, segments that are 0 where the target is eos or pad)."""
    shifted = F.concat(F.slice(targets, F.lit(2), F.greatest(F.lit(0), F.size(targets) - 1)), F.array(F.lit(eos)))
    return targets, shifted, F.transform(shifted, lambda t: F.when(t.isin(eos, pad), 0).otherwise(1))


def spliced(prompt: Column, completion: Column, length: int, eos: int) -> tuple[Column, Column, Column, Column]:
    """(tokens, positions, segments, completion mask) of a completion put behind its prompt and filled with zeros: segments are 1
    up to the first eos of the completion, positions 0 outside, the mask is 1 from the last prompt token on."""
    n = F.size(prompt)
    end = F.array_position(completion, eos).cast("int")
    real = n + F.when(end > 0, end).otherwise(F.size(completion))
    slots = F.sequence(F.lit(0), F.lit(length - 1))
    segment = F.transform(slots, lambda i: (i < real).cast("int"))
    return (
        pad_or_trim(F.concat(prompt, completion), length), F.transform(slots, lambda i: F.when(i < real, i).otherwise(0)),
        segment, F.transform(slots, lambda i: (i >= n - 1).cast("int")),
    )
