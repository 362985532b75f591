"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly (operator 1).

Rows of equal text form a group (nulls form one). A group that holds more than a share of 1 / (HEAVY * shards) of the bytes,
tokens or rows is an item of its own; one of more than half a shard is dealt into pieces by its rows' ids, since it can't be
placed whole without upsetting the balance. All other groups fall by hash into LOTS lots. The number of items is bounded by
these constants, whatever the input, so that the packing itself runs on the driver: items by falling bytes, each into the shard
where the dot product of its (bytes, tokens, rows) with the residual capacity is highest among those it fits in (in all, if it
fits nowhere). Slots are gapless numbers within a shard, from row numbers inside hash parts of a shard plus the parts' offsets.

Size is the text's UTF-8 bytes plus 1, tokens are runs without white space; a null text counts as empty, its checksum is 0.
Repeated rows are rows like others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LOTS = 16384
HEAVY = 64
SLOT_ROWS = 50_000
WEIGHTS = np.array([6.0, 1.0, 1.0])  # of bytes, tokens and rows in the dot product


def pack_items(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; sizes is (items, dimensions)."""
    share = sizes / np.maximum(sizes.sum(axis=0), 1e-12) * shards  # capacity 1 in each dimension
    left = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -share.max(axis=1), -share[:, 0])):
        v = share[i]
        fits = (left >= v).all(axis=1)
        gain = left @ (v * WEIGHTS)
        gain[~fits] -= 1e6 if fits.any() else 0
        out[i] = best = int(gain.argmax())
        left[best] -= v
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, n_tokens) with law `bytes`: the shards' sizes are nearly equal.
    tokens_col has token counts; without it words between white space count."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(r"\S+"))).cast("long").alias("n_tokens"),
        F.xxhash64(F.col(text_col).isNull(), text).alias("g"),
    )
    rows = staged(rows, "rows")
    sums = [F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
    share = F.greatest(*(F.col(c) / max(1, total[c]) for c in ("size", "n_tokens", "rows")))
    heavy = rows.groupBy("g").agg(*sums).withColumn("share", share).where(F.col("share") > 1 / (HEAVY * shards))
    heavy = [(r["g"], r["share"]) for r in heavy.collect()]  # at most 3 * HEAVY * shards groups
    parts = [(g, LOTS + 1000 * i, int(np.ceil(s * 4 * shards)) if s > 0.5 / shards else 1) for i, (g, s) in enumerate(sorted(heavy))]
    known = spark.createDataFrame(parts, "g long, first long, pieces int")
    item = F.when(F.col("first").isNull(), F.pmod(F.xxhash64("g", F.lit(3)), F.lit(LOTS))).otherwise(F.col("first") + F.pmod(F.xxhash64("id", F.lit(5)), F.col("pieces")))
    rows = rows.join(F.broadcast(known), "g", "left").withColumn("item", item).drop("g", "first", "pieces")
    items = sorted((r["item"], r["size"], r["n_tokens"], r["rows"]) for r in rows.groupBy("item").agg(*sums).collect())  # bounded as above
    placed = pack_items(np.array([x[1:] for x in items], float), shards)
    where = spark.createDataFrame([(x[0], int(s)) for x, s in zip(items, placed)], "item long, shard int")
    parts = max(4, -(-total["rows"] // (SLOT_ROWS * shards)))
    rows = rows.join(F.broadcast(where), "item").drop("item").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts)))
    rows = staged(rows, "placed")
    before = rows.groupBy("shard", "part").count()  # a row for each SLOT_ROWS rows
    before = before.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32")) - 1
    out = rows.withColumn("at", at).join(before, ["shard", "part"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
