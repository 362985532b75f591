"""Raking goes on until the margins hold, and tells when they can't."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixture


def raked(spark, cells, source, lang):
    cells = spark.createDataFrame([(*c, "t", n) for *c, n in cells], "source string, lang string, topic string, tokens long")
    given = {"source": source, "lang": lang, "topic": {"t": 1.0}}
    return mixture.rake(cells, {m: spark.createDataFrame(list(v.items()), f"{m} string, share double") for m, v in given.items()})


def test_slow_cells(spark):
    out = raked(spark, [("a", "x", 1000), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1000)], {"a": 0.5, "b": 0.5}, {"x": 0.45, "y": 0.55})
    share = dict(out.groupBy("source").agg(F.sum("w")).collect())
    assert abs(share["a"] - 0.5) < 1e-6


def test_margins_that_disagree(spark):
    with pytest.warns(UserWarning, match="gap of 0.1"):
        raked(spark, [("a", "x", 10), ("b", "y", 10)], {"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6})
