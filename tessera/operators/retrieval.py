"""Exact nearest vectors of a stated query set: rows of queries against blocks of vectors, by matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096  # vectors of a block
CHUNK = 512  # queries that meet a block at once


def _grouped(df: DataFrame, id_col: str, vector_col: str, size: int, name: str) -> tuple[DataFrame, int]:
    """(name, dim, ids, vectors): rows in groups of about `size` by a hash, and the number of groups."""
    groups = max(1, -(-df.count() // size))
    rows = df.where(F.col(vector_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(groups)).alias(name), F.size(vector_col).alias("dim"), F.struct(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).alias("r"))
    rows = rows.groupBy(name, "dim").agg(F.collect_list("r").alias("r"))
    return rows.select(name, "dim", F.col("r.id").alias(f"{name}_ids"), F.col("r.v").alias(f"{name}_v")), groups


def _pairs(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    blocks, n = _grouped(vectors, id_col, vector_col, BLOCK, "block")
    chunks, _ = _grouped(queries, id_col, vector_col, CHUNK, "chunk")
    each = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return each.join(blocks, ["block", "dim"]).select("chunk_ids", "chunk_v", "block_ids", "block_v")


def _compared(batches, pick):
    """What `pick(squared distances, query ids, vector ids, exact)` gives for every chunk and block; exact: squared distances of
    pairs without the rounding of products."""
    for batch in batches:
        for r in range(batch.num_rows):
            own, ids = (batch.column(c)[r].values.to_numpy() for c in (0, 2))
            q, x = (batch.column(c)[r].values.flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1) for c, i in ((1, own), (3, ids)))
            square = (x**2).sum(axis=1)[None, :] + (q**2).sum(axis=1)[:, None] - 2 * (q @ x.T)
            square[own[:, None] == ids[None, :]] = np.inf
            yield pick(square, own, ids, lambda a, b, q=q, x=x: ((q[a] - x[b]) ** 2).sum(axis=1))


def within(vectors: DataFrame, queries: DataFrame, d2: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, n): number of other vectors nearer than a squared distance, also where it is 0."""

    def pick(square, own, ids, exact):
        near = square < d2
        a, b = np.nonzero(np.abs(square - d2) < 1e-9 * (1 + d2))  # as near to the limit as rounding may reach
        near[a, b] = exact(a, b) < d2
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(near.sum(axis=1))], names=["query_id", "n"])

    found = _pairs(vectors, queries, id_col, vector_col).mapInArrow(lambda it: _compared(it, pick), "query_id long, n long")
    return found.groupBy("query_id").agg(F.sum("n").alias("n"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, d2, rank) of the k nearest other vectors, ties to the smaller id. Each block keeps its own k before
    blocks are merged."""

    def pick(square, own, ids, exact):
        limit = np.partition(square, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(own), np.inf)
        a, b = np.nonzero((square <= limit[:, None] + 1e-9 * (1 + np.abs(limit[:, None]))) & np.isfinite(square))
        d = exact(a, b)
        order = np.lexsort((ids[b], d, a))
        a, b, d = a[order], b[order], d[order]
        best = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
        return pa.RecordBatch.from_arrays([pa.array(own[a[best]]), pa.array(ids[b[best]]), pa.array(d[best])], names=["query_id", "vec_id", "d2"])

    some = _pairs(vectors, queries, id_col, vector_col).mapInArrow(lambda it: _compared(it, pick), "query_id long, vec_id long, d2 double")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))).where(F.col("rank") <= k)
