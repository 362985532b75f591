"""Shared parts: staged tables, bounded semi-join filters, connected components, vectorised text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, new_path, passing, settled, shared_dir, staged  # noqa: F401 (for the operators)


# ---------------------------------------------------------------- tables and columns
@contextlib.contextmanager
def rows_at_once(spark, n: int):
    """Arrow batches of at most n rows for what runs inside: for wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _marked(df: DataFrame, ids: DataFrame, column: str, most_bits: int) -> tuple[DataFrame, str]:
    """df with a new column (its name comes second): false where a bitmap of at most most_bits proves that `column` isn't in
    ids. The bitmap is a broadcast table of fixed size; false positives are for an exact join behind it."""
    n = ids.count()
    bits = 1 << 16
    while bits < 16 * n and bits < most_bits:
        bits *= 2
    word, mask, into = (fresh(df, x) for x in ("_word", "_mask", "_in"))
    at = f"pmod(xxhash64(`{column}`), {bits}L)"
    words = ids.selectExpr(f"{at} div 64 AS `{word}`", f"shiftleft(1L, cast({at} % 64 AS int)) AS b")
    words = words.groupBy(word).agg(F.bit_or("b").alias(mask))  # at most most_bits / 64 rows
    kept = df.withColumn(word, F.expr(f"{at} div 64")).join(F.broadcast(words), word, "left")
    return kept.withColumn(into, F.expr(f"coalesce((shiftrightunsigned(`{mask}`, cast({at} % 64 AS int)) & 1) = 1, false)")).drop(word, mask), into


def among(df: DataFrame, ids: DataFrame, column: str, most_bits: int = 1 << 26) -> DataFrame:
    """Rows of df whose `column` is in ids. Wide rows that can't match aren't shuffled."""
    return may_be_in(df, ids, column, most_bits).join(ids.select(column).distinct(), column, "left_semi").select(df.columns)


def may_be_in(df: DataFrame, ids: DataFrame, column: str, most_bits: int = 1 << 26) -> DataFrame:
    """Rows of df whose `column` may be in ids, for an exact join behind it."""
    marked, into = _marked(df, ids, column, most_bits)
    return marked.where(F.col(into)).drop(into)


def excluding(df: DataFrame, ids: DataFrame, column: str, most_bits: int = 1 << 26) -> DataFrame:
    """Rows of df whose `column` isn't in ids (a null isn't). Only rows that may be in ids are shuffled."""
    marked, into = _marked(df, ids, column, most_bits)
    near = marked.where(F.col(into)).drop(into).join(ids.select(column).distinct(), column, "left_anti").select(df.columns)
    return marked.where(~F.col(into)).select(df.columns).union(near)


def matched(df: DataFrame, more: DataFrame, column: str, most_bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """(rows of df joined to `more`, which has one row for each value of `column`; rows of df without one)."""
    marked, into = _marked(df, more.select(column), column, most_bits)
    near = marked.where(F.col(into)).drop(into).join(more, column, "left")
    return near, marked.where(~F.col(into)).select(df.columns)


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node reachable; edges has long columns a, b. Nodes without edges don't appear.
    Alternating large-star and small-star rounds, until every node has one edge, to a node that has none to smaller ones; each
    round is a staged table, and no list of links reaches the driver."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(most_rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
        if ends.where("low > 1 OR low = 1 AND top = 1").isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        last, now = now, staged(small, "cc")
        discard(last)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


# ---------------------------------------------------------------- vectorised text
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15
_MUL = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 21)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def released() -> None:
    """Give memory that a worker no longer needs back to the system: the process stays for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


_loaded: dict = {}


def per_worker(key, make: Callable):
    """What `make` gives, kept in each Python worker until it is asked for another one: a worker holds one model at a time."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make()
    return _loaded[key]


def lean(steps: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What steps give, in a worker without the model of an earlier step; then its memory goes back to the system."""
    if _loaded:
        _loaded.clear()
        gc.collect()
    yield from steps
    released()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `most` bytes of text each (a longer single text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


class Words:
    """Words of a run of texts: ASCII-whitespace-separated, with 64-bit hashes if hashed. Texts are joined in one byte array."""

    def __init__(self, data: np.ndarray, at: np.ndarray, fold: bool, hashed: bool = True):
        solid = ~_SPACE[data]
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        first = solid.copy()
        last = solid.copy()
        if n:
            first[1:] &= ~solid[:-1] | cut[1:n]
            last[:-1] &= ~solid[1:] | cut[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of text i are from bounds[i] up to bounds[i + 1]
        self.bounds = np.searchsorted(self.start, at)
        if not hashed:
            return
        up, down = _power_tables(n)
        table = _BYTE_FOLDED if fold else _BYTE
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the caller leaves out those that leave their text."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h += self.hash[j : j + m] * _MUL[j]
        return mix(h)


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole (short) sequence of word hashes."""
    out = len(h) + 1000
    for x in h.tolist():
        out = (out * 0x100000001B3 + x) % 2**64
    return int(mix(np.array([out], np.uint64))[0])


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
