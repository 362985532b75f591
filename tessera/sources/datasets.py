"""Datasets by type and by parts: dispatch, interleaved files, host shards, embedded databases, source code."""

from __future__ import annotations

import ast
import io
import pickle
import sqlite3
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import block_shuffle, dense_index, unit_hash
from . import readers

TYPES: dict[str, Callable[..., DataFrame]] = {
    "synthetic": lambda spark, **o: readers.synthetic(spark, o.get("rows", 1), o.get("length", 128), o.get("vocabulary", 256), o.get("seed", 0)),
    "files": lambda spark, **o: readers.read(spark, o["format"], o["path"], o.get("schema")),
    "placeholder": lambda spark, **o: readers.placeholder(spark, o.get("rows", 1), o.get("length", 128)),
}


def dataset(spark: SparkSession, kind: str, **options) -> tuple[DataFrame, str]:
    """(rows, type taken): an unknown type gives synthetic rows."""
    taken = kind if kind in TYPES else "synthetic"
    return TYPES[taken](spark, **options), taken


#: Evaluation variants of the public corpus: (already tokenised, split).
EVALUATION = {"en:3.0.1": (False, "validation"), "en:3.0.4": (False, "validation_24567exp"), "en:3.0.5": (True, "validation_tokenized_5662seqs"), "en:3.0.8": (False, "validation"), "en:3.0.9": (False, "validation")}


def evaluation_variant(version: str) -> tuple[bool, str]:
    if version not in EVALUATION:
        raise ValueError(f"no evaluation variant {version!r}")
    return EVALUATION[version]


def interleaved(files: DataFrame, path: str, seed: str, readers_at_once: int, window: int = 100) -> DataFrame:
    """Rows (path column, `at` within the file) with `pos`, an order in which files, shuffled by the seed, are read so many at a
    time in turn, and rows are then shuffled inside windows. Files' places come from a table with a row for each file."""
    names = dense_index(files.select(path).distinct().withColumn("u", unit_hash(seed, F.col(path))), "u", path, name="file").drop("u")
    turn = files.join(names, path).withColumn("cycle", F.floor(F.col("file") / readers_at_once))
    placed = dense_index(turn, "cycle", "at", "file", path)
    return block_shuffle(placed.withColumn("k", F.concat_ws("|", path, "at")), seed, "k", window).drop("k", "cycle", "idx")


def host_files(files: list[str], host: int, hosts: int) -> list[str]:
    """The files of one host of several: every hosts-th from its own number on; a ValueError where there are too few files."""
    if len(files) < hosts:
        raise ValueError(f"{len(files)} files for {hosts} hosts")
    return sorted(files)[host::hosts]


def checked_scheme(path: str) -> str:
    """Checks that a path's scheme is one that Spark's file systems read."""
    scheme = path.split("://")[0] if "://" in path else "file"
    if scheme in ("http", "https", "ftp"):
        raise NotImplementedError(f"{scheme} isn't a file system")
    return path


def sqlite_documents(spark: SparkSession, path: str, table: str = "documents") -> DataFrame:
    """(id, name, text, file, embedding) of a database file of documents, whose embeddings are pickled float arrays. The file lies
    on the driver and holds a bounded collection; only plain arrays are unpickled."""

    class Arrays(pickle.Unpickler):
        def find_class(self, module, name):
            if module.split(".")[0] == "numpy" and name in ("ndarray", "dtype", "_reconstruct", "_frombuffer", "scalar"):
                return super().find_class(module, name)
            raise pickle.UnpicklingError(f"{module}.{name} isn't an array")

    with sqlite3.connect(path) as db:
        rows = db.execute(f'SELECT id, name, text, file, embedding FROM "{table}"').fetchall()
    rows = [(*r[:4], np.asarray(Arrays(io.BytesIO(r[4])).load(), np.float32).tolist() if r[4] is not None else None) for r in rows]
    return spark.createDataFrame(rows, "id long, name string, text string, file string, embedding array<float>")


def python_blocks(files: DataFrame, text: str = "text", name: str = "path") -> DataFrame:
    """(name, kind, block, first_line, code): top-level functions, classes, tries and ifs of Python sources; a source that can't be
    parsed has none."""
    kinds = {ast.FunctionDef: "def", ast.AsyncFunctionDef: "def", ast.ClassDef: "class", ast.Try: "try", ast.If: "if"}

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for where, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError):
                    continue
                out += [(where, kinds[type(n)], getattr(n, "name", None), n.lineno, ast.get_source_segment(source, n)) for n in tree.body if type(n) in kinds]
            columns = list(zip(*out)) or [[]] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types)], names=["path", "kind", "block", "first_line", "code"])

    return files.select(name, text).mapInArrow(run, "path string, kind string, block string, first_line int, code string")
