"""Queries that write tables by one of the formats and read them again, and on values that sources give, with SQL that states the
same result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import metrics, sequences
from ..sources import datasets, measurement_records, readers, sinks
from ..staging import new_path
from .catalogue import DOCS, M, measurements, query, table, u
from .packing_queries import digest, joined, word_lengths


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events WHERE value IS NOT NULL) SELECT event_type, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM r WHERE r <= 5 GROUP BY 1")
def json_scan(spark, sf_dir):
    """Metrics as JSON lines; the newest five with the target."""
    path = new_path(spark, "json")
    readers.write(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "json", path)
    back = readers.read(spark, "json", path, "event_id long, event_type string, value double")
    last = metrics.last_n(back, ["event_type"], ["event_id"], "value", 5)
    return last.select("event_type", F.round("avg_v", 6).alias("mean"), F.round("sum_v", 4).alias("total"))


@query("SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'NA' ELSE s_nationkey::VARCHAR END AS nation FROM supplier")
def tsv_scan(spark, sf_dir):
    """A table of tabs with a header; empty cells are NA."""
    path = new_path(spark, "tsv")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("nation"))
    readers.write(rows, "tsv", path)
    back = readers.read(spark, "tsv", path)
    return back.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "name", F.coalesce(F.nullif("nation", F.lit("")), F.lit("NA")).alias("nation"))


@query("SELECT p_size::INTEGER AS size, count(*) AS n FROM part GROUP BY 1")
def text_scan(spark, sf_dir):
    """Stripped texts without empty ones, written compressed and read again."""
    path = new_path(spark, "texts")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit("\n")).alias("text"))
    sinks.write_texts(p.union(spark.createDataFrame([("  ",), (None,)], "text string")), path)
    return readers.read(spark, "parquet", path).groupBy(F.col("text").cast("int").alias("size")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN {u('9', 'event_id')} < 0.1 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def split_sink(spark, sf_dir):
    path = new_path(spark, "split")
    sinks.write_split(table(spark, sf_dir, "events").select("event_id"), path, "9", "event_id")
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id // 100 * 100 AS first_step, count(*) AS n, sum(event_id)::BIGINT AS steps, 'run' AS run_name FROM events GROUP BY 1")
def metrics_sink(spark, sf_dir):
    """Metric lines in files by the first step of their period."""
    path = new_path(spark, "metrics")
    e = table(spark, sf_dir, "events").where("event_id IS NOT NULL").select(F.col("event_id").alias("step"), "value")
    sinks.write_metrics(e, path, "run", 100)
    back = readers.read(spark, "json", path, "step long, value double, run_name string, first_step long")
    return back.groupBy("first_step", "run_name").agg(F.count("*").alias("n"), F.sum("step").alias("steps")).select("first_step", "n", "steps", "run_name")


@query(f"WITH {M} SELECT event_id, src, nullif(dst, '10.1.0.0') AS dst, round((CASE WHEN rtt < 0 THEN -1 ELSE floor(rtt * 4) / 4 END)::FLOAT::DOUBLE, 4) AS rtt, sec AS seconds FROM m")
def measurement_records_scan(spark, sf_dir):
    """Measurements as binary records and back; times in whole seconds."""
    m = measurements(spark, sf_dir)
    rows = m.select(F.concat("src", F.lit("|"), "event_id").alias("src_addr"), F.when(F.col("dst") != "10.1.0.0", F.col("dst")).alias("dst_addr"), F.lit(4).cast("long").alias("ip_version"), F.when(F.col("rtt") < 0, -1).otherwise(F.floor(F.col("rtt") * 4) / 4).cast("float").alias("rtt"), (F.col("sec") * 1_000_000 + 17).alias("time_us"))
    back = measurement_records.decode(measurement_records.encode(rows, "s"), unit="s")
    part = lambda i: F.split_part("src_addr", F.lit("|"), F.lit(i))
    return back.select(part(2).cast("long").alias("event_id"), part(1).alias("src"), F.col("dst_addr").alias("dst"), F.round(F.col("rtt").cast("double"), 4).alias("rtt"), F.expr("time_us div 1000000").alias("seconds"))


@query("SELECT i AS id, true AS shifted, 16 AS n FROM range(50) AS r(i)")
def synthetic_rows(spark, sf_dir):
    s = readers.synthetic(spark, 50, 16, 100, 3)
    one_ahead = F.slice("inputs", 2, 15) == F.slice("targets", 1, 15)
    return s.select("id", one_ahead.alias("shifted"), F.size("inputs").alias("n"))


@query("SELECT i AS id, '-1 -1 -1 -1' AS inputs, false AS real FROM range(6) AS r(i)")
def placeholder_rows(spark, sf_dir):
    p = datasets.dataset(spark, "placeholder", rows=6, length=4)[0]
    return p.select("id", joined(F.col("inputs")).alias("inputs"), F.exists("inputs", lambda x: x > -1).alias("real"))


@query("SELECT * FROM (VALUES ('a/*.parquet', 0.1667::DOUBLE), ('b/*', 0.3333::DOUBLE), ('c', 0.5::DOUBLE)) AS v(pattern, weight)")
def mixture_spec(spark, sf_dir):
    return spark.createDataFrame(readers.mixture_weights("a/*.parquet,1;b/*,2;c,3"), "pattern string, weight double")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name || 'x' ELSE '' END AS kept FROM part")
def stop_cuts(spark, sf_dir):
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("x</s>y##z"))).otherwise(F.concat(F.lit("##"), "p_name", F.lit("</s>")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.stop_cut(said, ["</s>", "##"]).alias("kept"))


@query(f"WITH {DOCS}, v AS (SELECT doc_id, list_transform(w, lambda x: length(x)) AS v FROM d) SELECT doc_id, md5(array_to_string(CASE WHEN len(v) = 0 THEN [0] ELSE list_concat([0], v[1:len(v) - 1]) END, ' ')) AS inputs, len(list_filter(v, lambda x: x <> 1))::INTEGER AS real FROM v")
def shifted_right(spark, sf_dir):
    """Decoder inputs: a zero in front, the last token gone; and the tokens that aren't pads (here words of one letter)."""
    v = word_lengths(spark, sf_dir)
    real = F.aggregate(sequences.segmentation(F.col("v"), 1), F.lit(0), lambda a, x: a + x)
    return v.select("doc_id", digest(sequences.shift_right(F.col("v"))).alias("inputs"), real.alias("real"))


@query("SELECT p_partkey AS id, array_to_string(list_concat(list_transform(range(least(8, p_size)), lambda i: i * 3), list_transform(range(8 - least(8, p_size)), lambda i: 99)), ' ') AS row_tokens FROM part")
def padded_matrix(spark, sf_dir):
    x = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: i * 3)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), joined(sequences.pad_or_trim(x.cast("array<int>"), 8, 99)).alias("row_tokens"))


@query("WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, count(*) AS held, max(turn) AS newest FROM s WHERE r <= 3 GROUP BY 1")
def first_records(spark, sf_dir):
    """The first records of each group, as a sample from the head of a file."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("r"))
    return c.where("r <= 3").groupBy("conv_id").agg(F.count("*").alias("held"), F.max("turn").alias("newest"))


@query("SELECT s_suppkey, 'b' || s_nationkey AS bucket, s_suppkey % 8 = 3 AS mine FROM supplier")
def host_files(spark, sf_dir):
    """Files of one host of eight, by the numbers in their names."""
    name = F.format_string("gs://b%d/f-%05d-of-00008", "s_nationkey", F.col("s_suppkey") % 8)
    _, number, _ = scoring.shard_name(name)
    return table(spark, sf_dir, "supplier").select("s_suppkey", scoring.bucket_and_prefix(name)[0].alias("bucket"), (number == 3).alias("mine"))
