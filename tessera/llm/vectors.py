"""Vector search: exact top-k by an impact-ordered index (operator 6), near neighbours by Hilbert curves (operator 8).

Only vectors that are not null and hold no null, NaN or infinite component take part, each against vectors of its own length.
Ids are longs; a row is never its own candidate (rows of equal id count as one row's copies and aren't candidates of each
other). Ties go to the smaller id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_at_once, staged
from .hilbert import hilbert_keys

BLOCK = 4096  # vectors of an index block
CHUNK = 1024  # queries that meet a block at once
AT_ONCE = 256  # of them, in a search
LARGEST = 4 * BLOCK  # of an index block: each query is sent to every block, so on many rows blocks are larger
CURVES = 8
PROJECTED = 6  # dimensions of each curve
BITS = 8
WINDOW = 16  # keys on each side of a query on each curve
QUERIES_AT_ONCE = 128  # of a chunk, against a block
FIT_ROWS = 4000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>, dim) of the vectors that take part."""
    fine = F.expr(f"`{vector_col}` IS NOT NULL AND forall(`{vector_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    rows = vectors.where(F.col(id_col).isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists of one row's list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


# ---------------------------------------------------------------- exact top-k
class ImpactIndex:
    """Postings of a block of integer vectors in segments of falling quantised impact.

    A posting is (dimension, vector) with the component's size rounded to a multiple of `step` as impact. Segments are taken
    one after the other, the largest impacts first, for all queries of a chunk; what a segment has not yet told of a vector is
    bounded by the norms of query and rest. When the k-th lower bound of every query leaves few vectors whose upper bound
    reaches it, or nothing is left, the possible members are rescored with the exact components.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        size = np.abs(x)
        top = int(size.max(initial=0))
        self.step = max(1, top // 32)
        impact = np.sign(x) * ((size + self.step // 2) // self.step) * self.step
        self.segments, rest, most = [], x.astype(np.float64), top + self.step
        low = max(self.step, top // 2)
        while True:
            inside = (np.abs(impact) >= low) & (np.abs(impact) < most) & (impact != 0)
            part = np.where(inside, impact, 0)
            rest = rest - part
            self.segments.append((part, np.sqrt((rest**2).sum(axis=1))))
            if low <= self.step:
                break
            most, low = low, max(self.step, low // 2)

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query places, vector places, exact scores) with the k best of each query among them. own: the queries' ids."""
        n = len(self.x)
        k = min(k, n)
        reach = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, q.shape[1])
        kind = np.float32 if reach * 2 < 2**24 else np.float64
        queries, norm = q.astype(kind), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        same = own[:, None] == ids[None, :] if np.isin(own, ids).any() else None
        score = np.zeros((len(q), n), kind)
        for i, (part, rest) in enumerate(self.segments):
            score += queries @ part.astype(kind).T
            slack = norm[:, None] * rest[None, :] * (1 + 1e-9) + reach * 1e-12
            low = score - slack
            if same is not None:
                low[same] = -np.inf
            if i + 1 < len(self.segments) and float(np.median(slack)) > float(np.abs(score).mean()) * 4:
                continue  # the bounds can't tell anything yet
            kth = np.partition(low, n - k, axis=1)[:, n - k]
            possible = score + slack >= kth[:, None]
            if same is not None:
                possible &= ~same
            if i + 1 == len(self.segments) or possible.sum() <= 8 * k * len(q):
                break
        a, b = np.nonzero(possible)
        if reach < 2**53:
            exact = np.concatenate([np.einsum("ij,ij->i", q[a[s : s + 65536]], self.x[b[s : s + 65536]]) for s in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
        else:  # beyond 64 bits on the way: whole numbers of Python
            exact = np.array([sum(int(x) * int(y) for x, y in zip(q[i], self.x[j])) for i, j in zip(a, b)], object)
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        place = np.arange(len(a)) - np.searchsorted(a, a, "left")
        return a[place < k], b[place < k], exact[place < k]


def _meet(batches, k: int):
    last: tuple = (None, None, None)
    for batch in batches:
        for r in range(batch.num_rows):
            row = {n: batch.column(n)[r] for n in ("block", "ids", "x", "own", "q")}
            ids, own = (row[n].values.to_numpy() for n in ("ids", "own"))
            if last[0] != row["block"].as_py():
                last = (row["block"].as_py(), ids, ImpactIndex(_matrix(row["x"].values, len(row["x"].values.flatten()) // max(1, len(ids)))))
            index = last[2]
            q = _matrix(row["q"].values, index.x.shape[1])
            for s in range(0, len(q), AT_ONCE):
                some = slice(s, s + AT_ONCE)
                a, b, score = index.search(q[some], own[some], ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[some][a]), pa.array(ids[b]), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])


def _block_pairs(rows: DataFrame, every: int, block_rows: int) -> DataFrame:
    """(block, ids, x, own, q): each chunk of queries beside each block of rows (id, dim, x). Spark knows a chunk's size but not how
    often it is repeated, so it would take the repeated chunks for a small table and broadcast them through the driver: the
    join is by sorting, whatever the sizes seem to be."""
    queries = rows.where(F.col("id") % every == 0)
    n, m = rows.count(), queries.count()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-m // CHUNK))
    # each block is one row of bounded size; each chunk of queries goes to every block: the query set against all rows, in blocks
    block = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), "dim", F.struct("id", "x").alias("r")).groupBy("b", "dim").agg(F.collect_list("r").alias("r"))
    block = block.select("b", "dim", F.concat_ws("-", "b", "dim").alias("block"), F.col("r.id").alias("ids"), F.col("r.x").alias("x"))
    chunk = queries.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).alias("c"), "dim", F.struct("id", "x").alias("r")).groupBy("c", "dim").agg(F.collect_list("r").alias("r"))
    chunk = chunk.select("c", "dim", F.col("r.id").alias("own"), F.col("r.x").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    return chunk.hint("merge").join(block, ["b", "dim"]).select("block", "ids", "x", "own", "q")


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): components become floor(scale * x); queries are the rows whose id is divisible by
    `every`, candidates all other rows; score is the integer inner product (beyond 64 bits is refused)."""
    rows = usable(vectors, id_col, vector_col).select("id", "dim", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("x"))
    rows = staged(rows.where("dim > 0"), "vectors")
    pairs = _block_pairs(rows, every, min(LARGEST, max(BLOCK, rows.count() // 64)))
    with rows_at_once(vectors.sparkSession, 8):  # rows are wide: a block and a chunk
        found = staged(pairs.mapInArrow(lambda it: _meet(it, k), "query_id long, vec_id long, score long"), "found")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# ---------------------------------------------------------------- near neighbours
class Curves:
    """CURVES Hilbert curves over random projections, each shifted; fitted on a bounded sample: its quantiles make the
    projected coordinates even."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        dim = sample.shape[1]
        rng = np.random.default_rng(seed)
        m = min(PROJECTED, dim)
        self.directions = [np.linalg.qr(rng.normal(size=(dim, m)))[0] for _ in range(CURVES)]
        self.shift = rng.random((CURVES, m)) / 2
        self.cuts = [np.sort(sample @ d, axis=0) for d in self.directions]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, curves) Hilbert keys."""
        out = np.empty((len(x), len(self.directions)), np.int64)
        for c, d in enumerate(self.directions):
            y = x @ d
            even = np.stack([np.searchsorted(self.cuts[c][:, j], y[:, j]) / len(self.cuts[c]) for j in range(y.shape[1])], axis=1)
            cells = ((even / 2 + self.shift[c]) * (1 << BITS)).astype(np.int64)
            out[:, c] = hilbert_keys(np.minimum(cells, (1 << BITS) - 1), BITS)
        return out


def _stacked(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distances(batches, dim: int):
    """(query_id, vec_id, score) of pairs with both vectors."""
    for batch in batches:
        if batch.num_rows:
            x, q = (_stacked(batch.column(i), dim) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((x - q) ** 2).sum(axis=1)))], names=["query_id", "vec_id", "score"])


def _balls(batches, dim: int):
    """Centre and radius of each block."""
    for batch in batches:
        for r in range(batch.num_rows):
            x = _stacked(batch.column("x")[r].values, dim)
            centre = x.mean(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("block").slice(r, 1), pa.array([centre.tolist()]), pa.array([float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())])], names=["block", "centre", "radius"])


def _nearest(batches, k: int, dim: int):
    """The k best of a block for each query, ties to the smaller id; what lies beyond a query's `reach` can't be among its best."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, own, reach = (batch.column(n)[r].values.to_numpy() for n in ("ids", "own", "reach"))
            x, q = (_stacked(batch.column(n)[r].values, dim) for n in ("x", "q"))
            size, size_q = (x**2).sum(axis=1), (q**2).sum(axis=1)
            for lo in range(0, len(q), QUERIES_AT_ONCE):
                some = slice(lo, lo + QUERIES_AT_ONCE)
                square = size[None, :] + size_q[some, None] - 2 * (q[some] @ x.T)
                square[own[some, None] == ids[None, :]] = np.inf
                blur = 1e-9 * (size_q[some] + size.max())  # more than what rounding can do
                limit = reach[some] ** 2
                if len(ids) > k:
                    limit = np.minimum(limit, np.partition(square, k - 1, axis=1)[:, k - 1])
                a, b = np.nonzero((square <= (limit + blur)[:, None]) & np.isfinite(square))
                d = np.sqrt(((x[b] - q[some][a]) ** 2).sum(axis=1))
                order = np.lexsort((ids[b], d, a))
                a, b, d = a[order], b[order], d[order]
                best = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
                yield pa.RecordBatch.from_arrays([pa.array(own[some][a[best]]), pa.array(ids[b[best]]), pa.array(d[best])], names=["query_id", "vec_id", "score"])


def near_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by `every`, by Euclidean distance on the
    original vectors, ties to the smaller id. Every row stands on every curve. Zero vectors take no part.

    1. A query meets the WINDOW keys on each side of it on each curve; the windows' members are merged and ranked by distance. The
       k-th of them bounds how far off any of the k nearest can be.
    2. Along the first curve rows make blocks and queries make chunks, each in a ball. A chunk meets only those blocks that come
       within the bound of one of its queries, and there only nearer rows than the bound are ranked. So the result is exact. On
       clustered vectors the bounds leave few blocks. In data without near neighbours (as isotropic ones in many dimensions) they
       leave most: then this step is a scan of the query set against all rows in blocks."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0)), "vectors")
    out = None
    for dim, n in sorted((r["dim"], r["count"]) for r in rows.groupBy("dim").count().collect()):  # lengths that occur
        mine = rows.where(F.col("dim") == dim).select("id", "v")
        sample = np.array([r["v"] for r in mine.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect()])
        model = spark.sparkContext.broadcast(Curves(sample))

        def keyed(batches, model=model, dim=dim):
            for batch in batches:
                if batch.num_rows:
                    keys = model.value.keys(_stacked(batch.column(1), dim))
                    c = keys.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), c)), pa.array(np.tile(np.arange(c, dtype=np.int32), len(keys))), pa.array(keys.ravel())], names=["id", "curve", "key"])

        on_curves = mine.mapInArrow(keyed, "id long, curve int, key long")
        ranged = staged(on_curves.repartitionByRange("curve", "key", "id").withColumn("part", F.spark_partition_id()), "curves")
        sizes = ranged.groupBy("curve", "part").agg(F.count("*").alias("n"))  # a row for each part and curve
        before = sizes.select("curve", "part", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")).alias("before"))
        place = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "id")) - 1
        placed = ranged.withColumn("at", place).join(before, ["curve", "part"]).select("id", "curve", (F.col("at") + F.col("before")).alias("at"))
        placed = staged(placed, "placed")

        # windows: ids first, then the vectors of each pair once
        asked = placed.where(F.col("id") % every == 0)
        around = asked.select(F.col("id").alias("query_id"), "curve", F.explode(F.sequence(F.col("at") - WINDOW, F.col("at") + WINDOW)).alias("at"))
        pairs = around.join(placed, ["curve", "at"]).where("query_id <> id").select("query_id", "id").distinct()
        queries = mine.where(F.col("id") % every == 0)
        met = pairs.join(mine, "id").join(queries.toDF("query_id", "q"), "query_id").select("query_id", F.col("id").alias("vec_id"), F.col("v").alias("x"), "q")
        seen = staged(met.mapInArrow(lambda it, dim=dim: _distances(it, dim), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "seen")
        kth = seen.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("r") == k)  # windows are bounded
        reach = kth.select(F.col("query_id").alias("id"), F.col("score").alias("reach"))

        # blocks and chunks along the first curve
        line = placed.where("curve = 0").select("id", "at").distinct()
        blocks = mine.join(line.select("id", F.floor(F.col("at") / BLOCK).alias("block")), "id").groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("r"))
        blocks = staged(blocks.select("block", F.col("r.id").alias("ids"), F.col("r.v").alias("x")), "blocks")
        wanted = queries.join(line, "id").join(reach, "id", "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"), F.floor(F.col("at") / (CHUNK * every)).alias("chunk"))
        chunks = wanted.groupBy("chunk").agg(F.collect_list(F.struct("id", "v", "reach")).alias("r"))
        chunks = staged(chunks.select("chunk", F.col("r.id").alias("own"), F.col("r.v").alias("q"), F.col("r.reach").alias("reach")), "chunks")
        ball = "block long, centre array<double>, radius double"
        balls = staged(blocks.select("block", "x").mapInArrow(lambda it, dim=dim: _balls(it, dim), ball), "balls")
        rings = chunks.select(F.col("chunk").alias("block"), F.col("q").alias("x")).mapInArrow(lambda it, dim=dim: _balls(it, dim), ball)
        rings = rings.toDF("chunk", "c", "r").join(chunks.select("chunk", F.array_max("reach").alias("reach")), "chunk")
        rings = rings.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // BLOCK).cast("long"))))
        apart = F.sqrt(F.aggregate(F.zip_with("c", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        close = rings.join(balls, "block").where(apart <= (F.col("r") + F.col("radius") + F.col("reach")) * (1 + 1e-9)).select("chunk", "block")
        both = close.join(chunks, "chunk").join(blocks, "block").select("ids", "x", "own", "q", "reach")
        found = both.mapInArrow(lambda it, dim=dim: _nearest(it, k, dim), "query_id long, vec_id long, score double")
        found = found.union(seen).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
