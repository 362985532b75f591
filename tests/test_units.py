import datetime
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import codec, scoring, text
from tessera.operators import evaluation, metrics, ordering, sequences, windows
from tessera.sources import measurement_records, readers
from tessera.streaming import metrics as live


def test_codec_lengths_and_round_trip(spark):
    df = spark.createDataFrame([("192.0.2.1", "8.8.8.8", 42.5, 1750766400, None), ("192.0.2.1", "8.8.4.4", 45.2, 1750766490, 1750766400), ("10.0.0.1", None, -1.0, 1750770000, 1750766490)], "s string, d string, r double, t long, p long")
    got = [r[0] for r in df.select(codec.measurement_tokens(*map(F.col, "sdrtp"))).collect()]
    assert [len(x) for x in got] == [23, 16, 17] and all(x[0] == 0 and all(0 <= t < 267 for t in x) for x in got)
    assert 10 in got[2]
    rtts = spark.createDataFrame([(x,) for x in (1.0, 10.0, 50.0, 100.0, 250.0, 1000.0, 302281.65625)], "r double")
    b = codec.rtt_bytes(F.col("r"))
    for r, back in rtts.select("r", codec.rtt_decode(*b)).collect():
        assert abs(back - r) / r < 1e-3
    with pytest.raises(Exception):
        spark.sql("SELECT '1.2.3' AS a").select(codec.ipv4_tokens(F.col("a"))).collect()


def test_dense_index_is_dense_over_partitions(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = sorted((r["idx"], r["k"]) for r in ordering.dense_index(df, "k", "id").collect())
    assert [i for i, _ in got] == list(range(1000)) and [k for _, k in got] == sorted(k for _, k in got)


def test_windows_against_loop(spark):
    for total, size, stride in ((10, 4, 4), (10, 4, 2), (10, 3, 5), (3, 8, 8)):
        got = {}
        for r in windows.window_rows(spark.range(total).withColumnRenamed("id", "idx"), total, size, stride).collect():
            got.setdefault(r["w"], []).append((r["at"], r["idx"]))
        n = max(1, (total - size) // stride + 1)
        assert {w: sorted(v) for w, v in got.items()} == {w: [(j, (w * stride + j) % total) for j in range(size)] for w in range(n)}


def test_pack_and_shift(spark):
    random.seed(1)
    n = [random.randint(0, 12) for _ in range(57)]
    df = spark.createDataFrame(list(enumerate(n)), "idx long, n int")
    want, bin_, used = [], -1, 0
    for i, x in enumerate(min(v, 10) for v in n):
        if i % 10 == 0:
            bin_, used = -1, 0
        if bin_ < 0 or used + x > 10:
            bin_, used = bin_ + 1, 0
        used += x
        want.append((i, bin_))
    assert sorted((r["idx"], r["bin"]) for r in sequences.greedy_pack(df, 10).collect()) == want
    a = spark.sql("SELECT array(4, 1, 5) AS x")
    assert a.select(sequences.shift_left(F.col("x"), 0), sequences.shift_right(F.col("x")), sequences.pad_or_trim(F.col("x"), 5, 9)).first()[:] == ([1, 5, 0], [0, 4, 1], [4, 1, 5, 9, 9])
    assert spark.sql("SELECT sequence(0, 7) AS x").select(sequences.balanced_order(F.col("x"), 2)).first()[0] == [0, 1, 6, 7, 2, 3, 4, 5]


def test_text(spark):
    df = spark.sql("SELECT 'steps #### 42 ' AS a, 'the answer is c' AS b, 'x STOP y END' AS c")
    assert df.select(text.hash_answer(F.col("a")), text.choice_letter(F.col("b")), text.stop_cut(F.col("c"), ["END", "STOP"])).first()[:] == ("42", "C", "x ")


def test_records_round_trip(spark):
    df = spark.createDataFrame([("1.2.3.4", None, 4, 1.5, 10), ("é", "b", 6, -1.0, 2)], measurement_records.SCHEMA)
    assert sorted(measurement_records.decode(measurement_records.encode(df)).collect(), key=str) == sorted(df.collect(), key=str)
    raw = measurement_records.encode(df.where("ip_version = 4"), "s").first()[0]
    assert bytes(raw) == b"\x07\x001.2.3.4\x00\x00" + struct.pack("<qfq", 4, 1.5, 0)


def test_sources(spark, tmp_path):
    readers.write(spark.range(3), "json", str(tmp_path / "j"))
    assert readers.read(spark, "json", str(tmp_path / "j"), "id long").count() == 3
    assert readers.mixture_weights("a,1;b,2") == [("a", 0.3333), ("b", 0.6667)]
    r = readers.synthetic(spark, 2, 4, 100).first()
    assert r["inputs"][1:] == r["targets"][:-1]
    with pytest.raises(ValueError):
        readers.read(spark, "nope", "x")
    assert [s for _, s in metrics.ramp_up(4, 16, 4, 60, 12)][:6] == [4, 4, 4, 4, 4, 8]


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("r", i, float(i)) for i in range(5)], "run string, step long, value double").coalesce(1).write.parquet(str(tmp_path / "s"))
    steps = readers.stream(spark, "parquet", str(tmp_path / "s"), "run string, step long, value double")
    for name, df in (("avg", live.moving_average(steps, 2)), ("trig", live.step_trigger(steps, 3))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert [r["mean"] for r in spark.sql("SELECT mean FROM avg ORDER BY step").collect()] == [0.0, 0.5, 1.5, 2.5, 3.5]
    assert spark.sql("SELECT * FROM trig").count() == 1
    assert t


def test_scoring(spark):
    df = spark.sql("SELECT 'v5e' AS v, 'a3mega' AS a, 256L AS n, array(9, 255, 8) AS t, array(1, 2, null) AS x, array(1, 2, 3) AS y, cast(array() AS array<int>) AS z, '3 failed, 12 passed in 1s' AS line, 'plain' AS name")
    c = F.col
    assert df.select(scoring.node_count(c("v"), c("n")), scoring.node_count(c("a"), c("n")), scoring.node_count(F.lit("cpu"), c("n"))).first()[:] == (64, 32, 256)
    assert df.select(scoring.insert_sequence(c("t"), 255, [255, -2], 5), scoring.insert_sequence(c("z"), 255, [1], 2)).first()[:] == ([9, 255, -2, 8, 0], [0, 0])
    assert df.select(scoring.common_prefix(c("x"), c("y")), scoring.common_prefix(c("y"), c("y")), scoring.common_prefix(c("z"), c("y"))).first()[:] == (2, 3, 0)
    assert df.select(scoring.alternate(c("t"), c("y")), scoring.alternate(c("z"), c("y"))).first()[:] == ([9, 1, 255, 2, 8, 3], [])
    assert df.select(*scoring.test_summary(c("line")), *scoring.shard_name(c("name"))).first()[:] == (12, 3, None, None, None)


def test_nucleus_keeps_the_last_and_ties(spark):
    rows = [(1, i, x) for i, x in enumerate((3.0, 2.0, 2.0, -5.0))] + [(2, 0, 1.0)]
    df = spark.createDataFrame(rows, "g int, i int, x double")
    assert sorted((r["g"], r["i"]) for r in evaluation.nucleus(df, ["g"], "x", "i", 0.7).collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert evaluation.nucleus(df, ["g"], "x", "i", 1.5).count() == 5
    assert evaluation.pad_to_batches(df.select("i"), 5, 4, "i").where("weight = 0").count() == 3
    assert evaluation.pad_to_batches(df.select("i"), 5, 5, "i").count() == 5
