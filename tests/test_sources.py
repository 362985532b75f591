"""Record files, dataset dispatch, databases, source code, writers, streams, checks on columns."""

import ipaddress
import pickle
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import codec, text
from tessera.operators import columns, graph
from tessera.sources import datasets, readers, sinks, tfrecord
from tessera.streaming import metrics as streaming


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def message(**named):
    kinds = {bytes: (1, lambda v: b"".join(field(1, x) for x in v)), float: (2, lambda v: field(1, struct.pack(f"<{len(v)}f", *v))), int: (3, lambda v: field(1, b"".join(varint(x % 2**64) for x in v)))}
    entries = b""
    for name, values in named.items():
        number, body = kinds[type(values[0])]
        entries += field(1, field(1, name.encode()) + field(2, field(number, body(values))))
    return field(1, entries)


def test_records(spark, tmp_path):
    rows = [message(text=[b" one "], ids=[1, -2, 300]), message(text=[b"  "], score=[0.5]), message(text=["zwei \u00e4".encode()], ids=[7])]
    (tmp_path / "a.rec").write_bytes(b"".join(map(tfrecord.framed, rows)))
    assert tfrecord.features(rows[1]) == {"text": [b"  "], "score": [0.5]}
    path = f"file://{tmp_path}/a.rec"
    assert [r[0] for r in tfrecord.read_texts(spark, path).collect()] == ["one", "zwei \u00e4"]
    assert [r[0] for r in tfrecord.read_texts(spark, path, most=2).collect()] == ["one"]
    assert [r[0] for r in tfrecord.read_numbers(spark, path, ["ids"]).collect()] == [[1, -2, 300], [], [7]]
    with pytest.raises(ValueError):
        list(tfrecord.records(tfrecord.framed(b"abc")[:-5]))


def test_datasets(spark, tmp_path):
    assert datasets.dataset(spark, "no such type", rows=2, length=4)[1] == "synthetic"
    assert datasets.evaluation_variant("en:3.0.5")[0] is True
    for wrong in (lambda: datasets.evaluation_variant("x"), lambda: datasets.host_files(["a"], 0, 2)):
        with pytest.raises(ValueError):
            wrong()
    assert datasets.host_files(["c", "a", "b"], 0, 2) == ["a", "c"]
    with pytest.raises(NotImplementedError):
        datasets.checked_scheme("https://x/y")
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("CREATE TABLE documents (id INTEGER, name TEXT, text TEXT, file TEXT, embedding BLOB)")
        db.execute("INSERT INTO documents VALUES (1, 'n', 't', 'f', ?), (2, 'm', NULL, 'f', NULL)", (pickle.dumps(np.array([1, 2], np.float32)),))
    assert [tuple(r) for r in datasets.sqlite_documents(spark, str(tmp_path / "d.db")).collect()] == [(1, "n", "t", "f", [1.0, 2.0]), (2, "m", None, "f", None)]
    code = spark.createDataFrame([("a.py", "import os\ndef f(x):\n    return x\n\nclass C:\n    pass\n"), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    assert [tuple(r)[:4] for r in datasets.python_blocks(code).collect()] == [("a.py", "def", "f", 2), ("a.py", "class", "C", 5)]
    files = spark.createDataFrame([(f"f{i % 4}", i // 4) for i in range(40)], "path string, at long")
    pos = datasets.interleaved(files, "path", "1", 2, 5).collect()
    assert sorted(r["pos"] for r in pos) == list(range(40)) and {r["path"] for r in pos if r["pos"] < 20} != {r["path"] for r in pos if r["pos"] >= 20}


def test_sinks(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.range(100).select("id", F.concat(F.lit(" t"), "id", F.lit(" ")).alias("text"))
    assert sum(sinks.write_split(df, f"{base}/split", "s", "id").values()) == 100
    sinks.write_batches(df, f"{base}/batches", "id", 30)
    assert spark.read.parquet(f"{base}/batches").groupBy("batch").count().count() == 4
    sinks.write_texts(df, f"{base}/texts")
    assert spark.read.parquet(f"{base}/texts").where("text = 't7'").count() == 1
    steps = lambda a, b: spark.range(a, b).select(F.col("id").alias("step"), (F.col("id") * 2).alias("loss"))
    for a, b, n in ((0, 10, 10), (10, 15, 15), (0, 5, 5)):
        sinks.write_metrics(steps(a, b), f"{base}/metrics", "r", 4)
        assert spark.read.json(f"{base}/metrics").count() == n
    sinks.write_dimensions(df, f"{base}/dims", ["id"])
    assert spark.read.json(f"{base}/dims").where("dimensions.id = 3").first()["metrics"]["text"] == " t3 "
    assert sinks.copied(spark, f"{base}/texts", f"{base}/copy") and not sinks.copied(spark, f"{base}/texts", f"{base}/copy")
    assert readers.find_files(spark, f"{base}/tex*/*.parquet") == sorted(f"file:{p}" for p in (tmp_path / "texts").glob("*.parquet"))
    with pytest.raises(FileNotFoundError):
        readers.find_files(spark, f"{base}/nothing*")
    assert [readers.pad_id(*x) for x in ((0, 3), (None, 3), (-1, None))] == [0, 3, -1]
    assert sinks.folder_bytes(spark, f"{base}/texts", "*.parquet") == sum(p.stat().st_size for p in (tmp_path / "texts").glob("*.parquet"))
    assert {tuple(r) for r in sinks.manifest(df.selectExpr("id % 2 AS shard"), "shard").collect()} == {(0, 50, 100), (1, 50, 100)}


def test_streams(spark, tmp_path):
    path, out, place = (f"file://{tmp_path}/{n}" for n in ("in", "out", "place"))
    schema = "run string, step long, value double, ts timestamp"
    rows = lambda *steps: spark.createDataFrame([("r", i, float(i), None) for i in steps], schema).withColumn("ts", F.timestamp_seconds("step"))
    rows(0, 1).write.mode("append").parquet(path)
    read = lambda: spark.readStream.schema(schema).parquet(path)
    streaming.resumable(read(), out, place)
    rows(2, 3, 9).write.mode("append").parquet(path)
    streaming.resumable(read(), out, place)
    assert sorted(r["step"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 9]
    for f, want in ((streaming.late_by_one, [0, 1, 2, 3]), (lambda s: streaming.time_trigger(s.select("run", "ts"), "3 seconds"), 1)):
        name = f"t{id(f)}"
        f(read()).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{place}-{name}").trigger(availableNow=True).start().awaitTermination()
        got = spark.table(name).collect()
        assert sorted(r["step"] for r in got) == want if isinstance(want, list) else len(got) == want
    assert streaming.heartbeats(spark, "r").isStreaming


def test_columns(spark):
    df = spark.createDataFrame([(1, [("user", "x")]), (1, [])], "id long, m array<struct<role: string, content: string>>")
    assert columns.is_conversational(df.schema, ["id", "m"]) and not columns.is_conversational(df.schema, ["id"])
    assert columns.check_shape(["question", "answer"]) == {"question", "answer"}
    for wrong in (lambda: columns.check_shape(["a"]), lambda: columns.check_unique(df, "id")):
        with pytest.raises(ValueError):
            wrong()
    assert columns.check_unique(df.limit(1), "id").count() == 1
    with pytest.raises(Exception, match="over 0"):
        df.select(columns.checked_length(F.col("m"), 0)).collect()
    filled = text.fill_template("{a} {{b}} {b} {c}", {"a": F.lit(" {b} "), "b": F.lit("y")})
    assert df.select(filled).first()[0] == "{b} {b} y {c}"


def test_addresses(spark):
    r = random.Random(4)
    known = [ipaddress.IPv6Address(r.getrandbits(128) & r.choice([2**128 - 1, 0xFFFF << 64 | 0xFFFF, (2**16 - 1) << 112])) for _ in range(60)]
    rows = [(str(a),) for a in known] + [(a.exploded.upper(),) for a in known] + [("",), (" ::1 ",), ("::ffff:1.2.3.4",), ("1::",)]
    want = [list(ipaddress.IPv6Address(a.strip() or "::").packed) for (a,) in rows]
    df = spark.createDataFrame(rows, "a string")
    assert [[t - 11 for t in x[0]] for x in df.select(codec.ipv6_tokens(F.col("a"))).collect()] == want
    for wrong in ("1::2::3", "12345::", "1:2:3", ":::", "1:2:3:4:5:6:7:8:9", "g::", "::1.2.3.400"):
        with pytest.raises(Exception, match="IPv6"):
            spark.createDataFrame([(wrong,)], "a string").select(codec.ipv6_tokens(F.col("a"))).collect()
    with pytest.raises(Exception, match="IP version"):
        df.select(codec.merged_address(F.col("a"), F.lit(5), True)).collect()


def test_block_order(spark):
    rows = [(i * 7919, 3 + i % 2) for i in range(50)]
    got = spark.createDataFrame(rows, "seed long, n int").select(codec.block_order(F.col("seed"), F.col("n"))).collect()
    for (seed, n), (order,) in zip(rows, got):
        want = list(range(n))
        random.Random(seed).shuffle(want)
        assert order == want


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (5, 1)], "src long, dst long")
    assert dict(graph.topological_levels(edges).collect()) == {5: 0, 1: 1, 2: -1, 3: -1, 4: -1}
    assert dict(graph.strong_components(edges).collect()) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    assert graph.strong_components(edges.where("false")).count() == 0
