"""What must not grow with the square of the input, or stay behind, in the steps of op6, op7 and the staged tables."""

import pathlib
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera import staging
from tessera.llm import ngram_join, vectors


def test_repeated_chunks_are_never_broadcast(spark):
    rows = spark.range(400).select("id", F.lit(4).alias("dim"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.col("id") * i * 37) % 512 - 256).alias("x"))
    pairs = vectors._block_pairs(staging.staged(rows, "rows"), 4, 16)
    assert pairs.count() == 25
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_staged_table_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {f for f in files if f.endswith(".data") and "shuffle_" in f}

    before = shuffled()
    out = staging.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    end = time.time() + 10
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before and out.count() == 7
    assert spark.conf.get(staging.CLEANUP) == "false"


def test_driver_gives_memory_back(spark, monkeypatch):
    """Staged tables have the driver's C library give back what is free in it, where the JVM has the command."""
    said, trimmed = [], staging._trimmed
    monkeypatch.setattr(staging, "_trimmed", lambda *a: said.append(trimmed(*a)))
    for _ in range(staging.GC_EVERY):
        staging.staged(spark.range(3), "few")
    assert len(said) == 1 and "Trim native heap" in said[0]


def test_pairs_in_a_block_pass_the_whole_sketch():
    """Two sets whose small sketches agree and whose whole ones don't are no pair."""
    far = np.zeros((3, ngram_join.FOLDED_WORDS), np.int64)
    far[1, :8] = -1  # folds to nothing: each bit stands in two words that fall together
    members = [{"id": i, "n": 100, "root": i, "sketch": far[i].tolist()} for i in range(3)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("sketch", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([members], kind)] * 2, names=["left", "right"])
    found = {p for out in ngram_join._near_in_block([batch], ngram_join.Fraction("0.8")) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    assert found == {(0, 2)}


def tables(spark):
    at = pathlib.Path(staging.shared_dir(spark).removeprefix("file://")) / "tessera"
    return {p.name for p in at.iterdir()} if at.exists() else set()


def test_tables_of_the_way_go(spark):
    """What a stage of the pipeline leaves in the shared folder is what its result reads."""
    words = [f"w{(i * i) % 997}" for i in range(400)]
    rows = [(1, " ".join(words[:200])), (2, " ".join(words[:199])), (3, " ".join(words[:200])), (4, " ".join(words[220:300] + words[20:90])), (5, None)]
    docs = spark.createDataFrame([(i, t, "a", "en", len(t or "")) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long")
    left = {"ngram_jaccard_join": {"gone", "several"}, "substring_dedup": {"spans"}, "mixture": {"undrawn"}}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = tables(spark)
        out = stage(spark, docs, "")
        assert {x.split("-")[0] for x in tables(spark) - before} == left.get(name, set())
        out.collect()  # and nothing that it reads is gone
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 4, 5]
    assert {r["doc_id"]: (r["text"] or "").split() for r in corpus_pipeline.substring_stage(spark, got, "").collect()}[4] == words[220:300]


def test_tables_of_a_failed_step_go(spark):
    before = tables(spark)

    def fails():
        inner = staging.settled(lambda: staging.staged(spark.range(3), "first").where("id > 0"), "inner")
        assert inner.count() == 2 and {x.split("-")[0] for x in tables(spark) - before} == {"inner"}
        raise ValueError

    with pytest.raises(ValueError):
        staging.settled(fails, "outer")
    assert tables(spark) == before
