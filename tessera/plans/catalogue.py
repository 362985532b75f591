"""Queries over the given tables, one for each operator family, with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, text
from ..operators import metrics, ordering, retrieval, sequences, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as network measurements."""
    u, e = F.col("user_id"), F.col("event_id")
    octet = lambda x: F.floor(x).cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"),
        F.concat(F.lit("10."), octet(u / 65536 % 256), F.lit("."), octet(u / 256 % 256), F.lit("."), octet(u % 256)).alias("src"),
        F.concat(F.lit("10.1."), octet(e / 256 % 256), F.lit("."), octet(e % 256)).alias("dst"),
        F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value")).alias("rtt"),
    )


M = """m AS (SELECT event_id, ts, user_id, event_type, epoch_us(ts) // 1000000 AS sec,
  '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS src,
  '10.1.' || (event_id // 256 % 256) || '.' || (event_id % 256) AS dst,
  CASE WHEN event_type = 'error' THEN -1.0 ELSE value END AS rtt FROM events)"""
IDX = "i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events)"
DOCS = "d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)"
U = "(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT / 4294967296.0)"


def u(seed: str, key: str) -> str:
    return U.format(seed=seed, key=key)


def indexed_events(spark, sf_dir) -> DataFrame:
    return ordering.dense_index(table(spark, sf_dir, "events"), "ts", "event_id")


def indexed_docs(spark, sf_dir) -> DataFrame:
    """(idx, doc_id, n): documents in order of their ids, with their numbers of words; the texts aren't shuffled."""
    return ordering.dense_index(table(spark, sf_dir, "documents").select("doc_id", F.size(text.words(F.coalesce("text", F.lit("")))).alias("n")), "doc_id")


# ---------------------------------------------------------------- profile, splits, shards, order
@query("SELECT count(*) AS n, min(epoch_us(ts)) AS min_us, max(epoch_us(ts)) AS max_us, max(epoch_us(ts)) - min(epoch_us(ts)) AS span_us FROM events")
def dataset_profile(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.min(us).alias("min_us"), F.max(us).alias("max_us"), (F.max(us) - F.min(us)).alias("span_us"))


@query(f"SELECT CASE WHEN {u('42', 'event_id')} < 0.1 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def hash_split(spark, sf_dir):
    return ordering.hash_split(table(spark, sf_dir, "events"), "42", "event_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH {IDX}, t AS (SELECT count(*) AS c FROM events) SELECT CASE WHEN idx < floor(c * 0.9) THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(epoch_us(ts)) AS min_us, max(epoch_us(ts)) AS max_us FROM i, t GROUP BY 1")
def time_prefix_split(spark, sf_dir):
    e = indexed_events(spark, sf_dir)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return ordering.prefix_split(e, e.count()).groupBy("split").agg(F.count("*").alias("n"), F.min(us).alias("min_us"), F.max(us).alias("max_us"))


@query(f"WITH {IDX}, t AS (SELECT count(*) AS c FROM events) SELECT least(idx // (c // 7), 6)::INTEGER AS shard, count(*) AS n, sum(event_id)::BIGINT AS ids FROM i, t GROUP BY 1")
def shard_assignment(spark, sf_dir):
    e = indexed_events(spark, sf_dir)
    return ordering.contiguous_shards(e, e.count(), 7).groupBy("shard").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH {IDX} SELECT (idx % 5)::INTEGER AS host, count(*) AS n, sum(event_id)::BIGINT AS ids FROM i GROUP BY 1")
def round_robin_shards(spark, sf_dir):
    return ordering.round_robin(indexed_events(spark, sf_dir), 5).groupBy("host").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id, epoch::INTEGER AS epoch FROM events, range(3) AS r(epoch)")
def epoch_repeat(spark, sf_dir):
    return ordering.repeat_epochs(table(spark, sf_dir, "events").select("event_id"), 3)


@query(f"SELECT row_number() OVER (ORDER BY {u('7', 'doc_id')}, doc_id) - 1 AS pos, doc_id FROM documents")
def hash_shuffle(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").withColumn("u", ordering.unit_hash("7", F.col("doc_id")))
    return ordering.dense_index(d, "u", "doc_id", name="pos").select("pos", "doc_id")


@query(f"WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) SELECT idx // 100 * 100 + row_number() OVER (PARTITION BY idx // 100 ORDER BY {u('7', 'doc_id')}, doc_id) - 1 AS pos, doc_id FROM d")
def block_shuffle(spark, sf_dir):
    d = ordering.dense_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return ordering.block_shuffle(d, "7", "doc_id", 100).select("pos", "doc_id")


@query(f"SELECT event_id, epoch_us(ts) AS ts_us FROM (SELECT * FROM events ORDER BY {u('s', 'event_id')}, event_id LIMIT 25) ORDER BY ts, event_id")
def sample_reordered(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("u", ordering.unit_hash("s", F.col("event_id")))
    return e.orderBy("u", "event_id").limit(25).orderBy("ts", "event_id").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query(f"WITH {IDX}, t AS (SELECT count(*) AS c FROM events) SELECT event_id FROM i, t WHERE idx >= c // 2 AND idx < c // 2 + 100")
def middle_slice(spark, sf_dir):
    e = indexed_events(spark, sf_dir)
    half = e.count() // 2
    return e.where((F.col("idx") >= half) & (F.col("idx") < half + 100)).select("event_id")


@query("WITH k AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 0.5::DOUBLE) / CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.25::DOUBLE WHEN 'fr' THEN 0.125::DOUBLE WHEN 'es' THEN 0.125::DOUBLE END AS place FROM documents) SELECT doc_id, lang, round(place, 6) AS place FROM k")
def weighted_interleave(spark, sf_dir):
    """Places of all documents in a mixture of languages; a language without a weight has none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ordering.interleave(d, "lang", "doc_id", {"en": 4, "de": 2, "fr": 1, "es": 1}).select("doc_id", "lang", F.round("at", 6).alias("place"))


@query("SELECT source AS component, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS weight FROM documents GROUP BY 1")
def mixture_ratio(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("component")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("component", "n", F.round(F.col("n") / F.col("t"), 4).alias("weight"))


@query("SELECT doc_id FROM (SELECT doc_id, sum(strlen(coalesce(text, '')) + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - strlen(coalesce(text, '')) - 1 AS before FROM documents) WHERE before < 1000000")
def char_budget_prefix(spark, sf_dir):
    d = ordering.dense_index(table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("n")), "doc_id")
    return sequences.token_offsets(d, "n").where(F.col("offset") < 1_000_000).select("doc_id")


# ---------------------------------------------------------------- codec
RTT_SQL = """e AS (SELECT event_id, rtt, greatest(1, floor(rtt * 1000.0))::BIGINT AS us FROM m WHERE rtt >= 0),
  x AS (SELECT *, least(31, greatest(0, length(bin(us)) - 11)) AS ex FROM e),
  r AS (SELECT *, (ex * 2048 + least(2047, floor(us / power(2, ex))))::BIGINT AS word FROM x)"""


@query(f"WITH {M}, {RTT_SQL} SELECT event_id, (word // 256)::INTEGER AS b1, (word % 256)::INTEGER AS b2 FROM r")
def rtt_encode(spark, sf_dir):
    b1, b2 = codec.rtt_bytes(F.col("rtt"))
    return measurements(spark, sf_dir).where("rtt >= 0").select("event_id", b1.alias("b1"), b2.alias("b2"))


@query(f"WITH {M}, {RTT_SQL}, b AS (SELECT us / 1000.0 AS ms, (word % 2048) * power(2, word // 2048) / 1000.0 AS back FROM r) SELECT round(max(abs(back - ms) / ms), 6) AS max_err, round(avg(abs(back - ms) / ms), 6) AS avg_err FROM b")
def rtt_roundtrip_error(spark, sf_dir):
    b1, b2 = codec.rtt_bytes(F.col("rtt"))
    ms = F.greatest(F.lit(1).cast("long"), F.floor(F.col("rtt") * 1000.0)) / 1000.0
    err = F.abs(codec.rtt_decode(b1, b2) - ms) / ms
    return measurements(spark, sf_dir).where("rtt >= 0").agg(F.round(F.max(err), 6).alias("max_err"), F.round(F.avg(err), 6).alias("avg_err"))


@query(f"WITH {M}, p AS (SELECT event_id, unnest(string_split(src, '.')) AS o, generate_subscripts(string_split(src, '.'), 1) - 1 AS pos FROM m) SELECT event_id, pos::INTEGER AS pos, (o::INTEGER + 11)::INTEGER AS token FROM p")
def ipv4_tokens(spark, sf_dir):
    return measurements(spark, sf_dir).select("event_id", F.posexplode(codec.ipv4_tokens(F.col("src"))).alias("pos", "token"))


LAG = "l AS (SELECT *, lag(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM m)"
TIME_SQL = """CASE WHEN prev IS NULL THEN list_concat([5], list_transform(range(8), lambda i: ((sec >> (56 - 8 * i)) & 255) + 11))
  WHEN sec - prev < 256 THEN [6, greatest(0, sec - prev) + 11]
  ELSE list_concat([7], list_transform(range(4), lambda i: (((sec - prev) >> (24 - 8 * i)) & 255) + 11)) END"""


def with_previous(m: DataFrame) -> DataFrame:
    return m.withColumn("prev", F.lag("sec").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


@query(f"WITH {M}, {LAG} SELECT event_id, array_to_string({TIME_SQL}, ' ') AS tokens FROM l")
def timestamp_block(spark, sf_dir):
    return with_previous(measurements(spark, sf_dir)).select("event_id", F.array_join(codec.time_block(F.col("sec"), F.col("prev")).cast("array<string>"), " ").alias("tokens"))


@query(f"""WITH {M}, {LAG}, r AS (SELECT *, greatest(1, floor(rtt * 1000.0))::BIGINT AS us FROM l), x AS (SELECT *, least(31, greatest(0, length(bin(us)) - 11)) AS ex FROM r),
  w AS (SELECT *, (ex * 2048 + least(2047, floor(us / power(2, ex))))::BIGINT AS word FROM x)
  SELECT event_id, array_to_string(list_concat(list_concat(list_concat([0, 1], list_transform(string_split(src, '.'), lambda o: o::BIGINT + 11)), list_concat([2], list_transform(string_split(dst, '.'), lambda o: o::BIGINT + 11))),
  list_concat(CASE WHEN rtt < 0 THEN [10] ELSE [8, word // 256 + 11, word % 256 + 11] END, {TIME_SQL})), ' ') AS tokens FROM w""")
def measurement_tokens(spark, sf_dir):
    t = codec.measurement_tokens(*map(F.col, ("src", "dst", "rtt", "sec", "prev")))
    return with_previous(measurements(spark, sf_dir)).select("event_id", F.array_join(t.cast("array<string>"), " ").alias("tokens"))


@query(f"WITH {M}, {LAG}, n AS (SELECT CASE WHEN prev IS NULL THEN 'first' ELSE 'next' END AS class, 11 + CASE WHEN rtt < 0 THEN 1 ELSE 3 END + CASE WHEN prev IS NULL THEN 9 WHEN sec - prev < 256 THEN 2 ELSE 5 END AS n FROM l) SELECT class, min(n)::INTEGER AS min_n, max(n)::INTEGER AS max_n, round(avg(n), 6) AS avg_n FROM n GROUP BY 1")
def token_length_distribution(spark, sf_dir):
    n = F.size(codec.measurement_tokens(*map(F.col, ("src", "dst", "rtt", "sec", "prev"))))
    m = with_previous(measurements(spark, sf_dir)).select(F.when(F.col("prev").isNull(), "first").otherwise("next").alias("class"), n.alias("n"))
    return m.groupBy("class").agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.round(F.avg("n"), 6).alias("avg_n"))


@query(f"WITH {M}, {LAG} SELECT event_id, greatest(0, sec - prev) AS delta_s FROM l WHERE prev IS NOT NULL")
def lag_delta(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("delta_s", windows.lag_seconds("sec", ["ts", "event_id"], ["user_id"]))
    return m.where(F.col("delta_s").isNotNull()).select("event_id", "delta_s")


@query(f"WITH {M}, {LAG}, c AS (SELECT CASE WHEN prev IS NULL THEN 'absolute' WHEN sec - prev < 256 THEN 'one byte' ELSE 'four bytes' END AS class FROM l) SELECT class, count(*) AS n FROM c GROUP BY 1")
def delta_class_ratio(spark, sf_dir):
    kind = F.element_at(codec.time_block(F.col("sec"), F.col("prev")), 1)
    return with_previous(measurements(spark, sf_dir)).groupBy(F.when(kind == 5, "absolute").when(kind == 6, "one byte").otherwise("four bytes").alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT event_id, ('0x' || substr(md5(src || '|' || dst || '|' || sec), 1, 8))::BIGINT AS seed FROM m")
def shuffle_seed(spark, sf_dir):
    return measurements(spark, sf_dir).select("event_id", codec.shuffle_seed(F.col("src"), F.col("dst"), F.col("sec")).alias("seed"))


@query(f"WITH {M} SELECT * FROM (SELECT event_id, last_value(CASE WHEN {u('c', 'event_id')} < 0.5 THEN sec END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m) WHERE prev IS NOT NULL")
def last_timestamped(spark, sf_dir):
    coin = ordering.unit_hash("c", F.col("event_id")) < 0.5
    return measurements(spark, sf_dir).select("event_id", windows.last_marked("sec", coin, ["ts", "event_id"], ["user_id"]).alias("prev")).where("prev IS NOT NULL")


# ---------------------------------------------------------------- windows
@query(f"WITH {IDX}, t AS (SELECT count(*) AS c FROM events) SELECT idx // 64 AS w, count(*) AS n, sum(event_id)::BIGINT AS ids FROM i, t WHERE idx // 64 < greatest(1, (c - 64) // 64 + 1) GROUP BY 1")
def row_windows_tumbling(spark, sf_dir):
    e = indexed_events(spark, sf_dir)
    return windows.window_rows(e, e.count(), 64).groupBy("w").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH {IDX}, t AS (SELECT count(*) AS c FROM events), w AS (SELECT unnest(range(greatest(1, (c - 64) // 16 + 1))) AS w FROM t) SELECT w, count(*) AS n, min(idx) AS first_idx, sum(event_id)::BIGINT AS ids FROM w JOIN i ON idx >= w * 16 AND idx < w * 16 + 64 GROUP BY 1")
def row_windows_sliding(spark, sf_dir):
    e = indexed_events(spark, sf_dir)
    return windows.window_rows(e, e.count(), 64, 16).groupBy("w").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.sum("event_id").alias("ids"))


@query(f"WITH {IDX}, w AS (SELECT DISTINCT idx // 64 AS w FROM i), c AS (SELECT w, {u('m', 'w')} AS u FROM w) SELECT w, CASE WHEN u < 0.4 THEN 'ordered' WHEN u < 0.7 THEN 'shuffled' ELSE 'mixed' END AS mode FROM c")
def window_modes(spark, sf_dir):
    w = indexed_events(spark, sf_dir).select(F.floor(F.col("idx") / 64).alias("w")).distinct()
    r = ordering.unit_hash("m", F.col("w"))
    return w.select("w", F.when(r < 0.4, "ordered").when(r < 0.7, "shuffled").otherwise("mixed").alias("mode"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) + 0.0000001, 4) AS avg50 FROM events")
def moving_average(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(windows.moving_average("value", 50, ["ts", "event_id"], ["event_type"]) + 0.0000001, 4).alias("avg50"))


# ---------------------------------------------------------------- sequences
@query(f"WITH {DOCS}, c AS (SELECT doc_id, w, unnest(range((len(w) + 127) // 128)) AS chunk FROM d) SELECT doc_id, chunk::INTEGER AS chunk, len(w[chunk * 128 + 1 : chunk * 128 + 128])::INTEGER AS n, md5(array_to_string(w[chunk * 128 + 1 : chunk * 128 + 128], ' ')) AS digest FROM c")
def chunk_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.words(F.coalesce("text", F.lit(""))).alias("w"))
    return d.select("doc_id", F.posexplode(sequences.chunks(F.col("w"), 128)).alias("chunk", "t")).select("doc_id", "chunk", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {DOCS}, t AS (SELECT doc_id, list_transform(w[1:32], lambda x: length(x)) AS t FROM d) SELECT doc_id, len(t)::INTEGER AS n_real, array_to_string(list_concat(t, list_transform(range(32 - len(t)), lambda i: 0)), ' ') AS tokens FROM t")
def trim_pad(spark, sf_dir):
    t = F.transform(F.slice(text.words(F.coalesce("text", F.lit(""))), 1, 32), F.length)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_real"), F.array_join(sequences.pad_or_trim(t, 32).cast("array<string>"), " ").alias("tokens"))


@query(f"WITH {DOCS}, t AS (SELECT doc_id, list_transform(w, lambda x: length(x)) AS t FROM d WHERE len(w) > 0) SELECT doc_id, md5(array_to_string(list_concat(t[2:], [0]), ' ')) AS targets, md5(array_to_string(list_transform(list_concat(t[2:], [0]), lambda x: CASE WHEN x IN (0, 1) THEN 0 ELSE 1 END), ' ')) AS segments FROM t")
def shift_targets(spark, sf_dir):
    """Targets and segments of whole texts."""
    t = F.transform(text.words(F.coalesce("text", F.lit(""))), F.length)
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).where(F.size("t") > 0).withColumn("g", sequences.shift_left(F.col("t"), 0))
    seg = sequences.mask_ignored(F.transform("t", lambda x: F.lit(1)), F.col("g"), [0, 1])
    return d.select("doc_id", F.md5(F.array_join(F.col("g").cast("array<string>"), " ")).alias("targets"), F.md5(F.array_join(seg.cast("array<string>"), " ")).alias("segments"))


@query(f"WITH {DOCS}, o AS (SELECT doc_id, len(w) AS n, coalesce(sum(len(w)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM d), c AS (SELECT *, unnest(range(o // 1024, (o + n - 1) // 1024 + 1)) AS chunk FROM o WHERE n > 0) SELECT chunk, sum(least((chunk + 1) * 1024, o + n) - greatest(chunk * 1024, o))::BIGINT AS n, count(*) AS n_docs FROM c GROUP BY 1")
def concat_then_split(spark, sf_dir):
    d = indexed_docs(spark, sf_dir).withColumn("n", F.col("n").cast("long"))
    return sequences.concat_then_split(sequences.token_offsets(d, "n"), 1024).groupBy("chunk").agg(F.sum("tokens").alias("n"), F.count("*").alias("n_docs"))


@query(f"""WITH RECURSIVE {DOCS}, e AS (SELECT idx, least(len(w), 64)::INTEGER AS n FROM d),
  f AS (SELECT idx, n, 0 AS bin, n AS used FROM e WHERE idx % 64 = 0
        UNION ALL SELECT e.idx, e.n, CASE WHEN f.used + e.n <= 64 THEN f.bin ELSE f.bin + 1 END, CASE WHEN f.used + e.n <= 64 THEN f.used + e.n ELSE e.n END FROM f JOIN e ON e.idx = f.idx + 1 AND e.idx % 64 <> 0)
  SELECT idx // 64 AS block, bin, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM f GROUP BY 1, 2""")
def greedy_pack(spark, sf_dir):
    d = indexed_docs(spark, sf_dir).select("idx", F.least("n", F.lit(64)).alias("n"))
    return sequences.greedy_pack(d, 64).groupBy("block", "bin").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


@query(f"WITH {IDX} SELECT idx // 32 AS batch, count(*) AS n, sum(event_id)::BIGINT AS ids FROM i GROUP BY 1 HAVING count(*) = 32")
def batch_drop_remainder(spark, sf_dir):
    return indexed_events(spark, sf_dir).groupBy(F.floor(F.col("idx") / 32).alias("batch")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).where("n = 32")


@query(f"WITH {DOCS} SELECT CASE WHEN len(w) <= 64 THEN 64 WHEN len(w) <= 128 THEN 128 WHEN len(w) <= 256 THEN 256 WHEN len(w) <= 512 THEN 512 ELSE 1024 END AS bucket, count(*) AS n FROM d GROUP BY 1")
def prefill_buckets(spark, sf_dir):
    n = F.size(text.words(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").groupBy(sequences.bucket_of(n, [64, 128, 256, 512, 1024]).alias("bucket")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- conversations
@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, md5(coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS digest FROM conversations GROUP BY 1")
def split_roles(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    of = lambda role: F.filter("m", lambda x: x["role"] == role)
    said = F.array_join(F.transform(of("assistant"), lambda x: x["text"]), "|")
    return m.select("conv_id", F.size(of("user")).cast("long").alias("n_user"), F.size(of("assistant")).cast("long").alias("n_assistant"), F.md5(said).alias("digest"))


@query("WITH w AS (SELECT *, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations) SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS n_completion, sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END)::BIGINT AS n_masked FROM w GROUP BY 1")
def prompt_mask(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    tokens = F.transform("m", lambda x: F.transform(text.words(x["text"]), lambda w: F.lit(1)))
    t = sequences.prompt_mask(tokens, F.transform("m", lambda x: x["role"] != "assistant"), -1)
    return m.select("conv_id", t.alias("t")).select("conv_id", F.size(F.filter("t", lambda x: x > 0)).cast("long").alias("n_completion"), F.size(F.filter("t", lambda x: x < 0)).cast("long").alias("n_masked"))


CONV = "c AS (SELECT conv_id, turn, trunc(1.3::DOUBLE * len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS n FROM conversations WHERE role <> 'system'), k AS (SELECT conv_id, count(*) AS turns, min_by(n, turn) AS n_in, (array_agg(n ORDER BY turn))[2] AS n_out FROM c GROUP BY 1), f AS (SELECT conv_id, n_in, n_out FROM k WHERE turns >= 2 AND n_in <= 1024 AND n_out <= 1024)"


def kept_conversations(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", F.struct("turn", text.approximate_tokens(F.col("text")).alias("n")).alias("m"))
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m")).where(F.size("m") >= 2)
    return m.select("conv_id", F.col("m")[0]["n"].alias("n_in"), F.col("m")[1]["n"].alias("n_out")).where("n_in <= 1024 AND n_out <= 1024")


@query(f"WITH {CONV} SELECT * FROM f")
def conversation_filter(spark, sf_dir):
    return kept_conversations(spark, sf_dir)


PREFILL_MS = {64: 9.174, 128: 11.087, 256: 18.468, 512: 29.128, 1024: 58.386}  # fixed values: measured latency by bucket
TOKEN_MS = 0.32591875


@query(f"WITH {CONV}, b AS (SELECT *, CASE WHEN n_in <= 128 THEN 11.087::DOUBLE WHEN n_in <= 256 THEN 18.468 WHEN n_in <= 512 THEN 29.128 ELSE 58.386 END AS p FROM f) SELECT round(sum(p) / 1000, 6) AS prefill_s, round(sum(n_out) * 0.32591875::DOUBLE / 1000, 6) AS generate_s, count(*) AS n FROM b")
def throughput_estimate(spark, sf_dir):
    c = kept_conversations(spark, sf_dir).withColumn("bucket", text.next_power_of_two(F.col("n_in"), 128))
    ms = F.create_map(*(F.lit(x) for kv in PREFILL_MS.items() for x in kv))
    return c.agg(F.round(F.sum(ms[F.col("bucket")]) / 1000, 6).alias("prefill_s"), F.round(F.sum("n_out") * TOKEN_MS / 1000, 6).alias("generate_s"), F.count("*").alias("n"))


# ---------------------------------------------------------------- scoring and metrics
@query("SELECT p_partkey AS id, 'Subject: ' || replace(p_brand, '_', ' ') || chr(10) || p_name || chr(10) || 'A. ' || p_type || chr(10) || 'B. ' || p_brand AS prompt FROM part")
def choice_prompt(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.choice_prompt(F.col("p_brand"), F.col("p_name"), F.array("p_type", "p_brand")).alias("prompt"))


@query("SELECT p_partkey AS id, chr(65 + (p_size % 4)::INTEGER) AS letter FROM part")
def choice_parse(spark, sf_dir):
    said = F.concat(F.when(F.col("p_partkey") % 2 == 0, "So the ANSWER is ").otherwise("Answer: "), F.char(F.col("p_size") % 4 + 65), F.lit(". Done"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.choice_letter(said).alias("letter"))


ANSWERS = "a AS (SELECT p_partkey AS id, p_size AS truth, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN ' ' || p_size WHEN 2 THEN (p_size + 1)::VARCHAR WHEN 3 THEN 'n/a' ELSE NULL END AS guess FROM part)"


@query(f"WITH {ANSWERS} SELECT id, CASE WHEN guess IS NULL THEN 0.0 WHEN guess = truth::VARCHAR THEN 3.0 WHEN trim(guess) = truth::VARCHAR THEN 1.5 WHEN try_cast(guess AS DOUBLE) IS NULL OR truth = 0 THEN -0.5 WHEN guess::DOUBLE / truth BETWEEN 0.9 AND 1.1 THEN 0.5 WHEN guess::DOUBLE / truth BETWEEN 0.8 AND 1.2 THEN 0.25 ELSE -1.0 END::DOUBLE AS score FROM a")
def answer_reward(spark, sf_dir):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    guess = F.when(k == 0, size).when(k == 1, F.concat(F.lit(" "), size)).when(k == 2, (F.col("p_size") + 1).cast("string")).when(k == 3, "n/a")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.answer_reward(guess, size).alias("score"))


@query("SELECT doc_id, (CASE WHEN (length(text) - length(replace(text, 'the', ''))) / 3 = 1 THEN 0.5 ELSE -0.5 END + CASE WHEN length(text) - length(replace(text, '|', '')) = 1 THEN 0.5 ELSE -0.5 END)::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def format_reward(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", text.format_reward(F.col("text"), ["the", "|"]).alias("score"))


@query("""WITH s AS (SELECT r_name, n_name, s_acctbal > 4000 AS ok FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT 'overall' AS level, 'all' AS name, count(*) AS n, round(avg(ok::INTEGER), 6) AS accuracy FROM s UNION ALL SELECT 'r_name', r_name, count(*), round(avg(ok::INTEGER), 6) FROM s GROUP BY r_name UNION ALL SELECT 'n_name', n_name, count(*), round(avg(ok::INTEGER), 6) FROM s GROUP BY n_name""")
def hierarchical_accuracy(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = metrics.accuracy_levels(s.select("r_name", "n_name", (F.col("s_acctbal") > 4000).cast("int").alias("ok")), ["r_name", "n_name"], "ok")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 0.0001), 6) AS adv FROM events WINDOW w AS (PARTITION BY event_id // 8)")
def group_advantage(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("g", F.floor(F.col("event_id") / 8))
    return metrics.group_advantage(e, ["g"], "value").select("event_id", F.round("advantage", 6).alias("adv"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL) SELECT event_type, round(avg(value), 6) AS avg_v, round(median(value), 6) AS median_v, count(*) AS n FROM r WHERE r <= 10 GROUP BY 1")
def last_n_stats(spark, sf_dir):
    out = metrics.last_n(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value", 10)
    return out.select("event_type", F.round("avg_v", 6).alias("avg_v"), F.round("median_v", 6).alias("median_v"), "n")


@query("SELECT event_id AS step, round(value, 3) AS seconds, round(value / 2, 3) AS loss FROM events")
def log_parse(spark, sf_dir):
    line = F.format_string("completed step: %d, seconds: %.3f, TFLOP/s/device: 1.5, Tokens/s/device: 2.0, total_weights: 64, loss: %.3f", "event_id", F.round("value", 3), F.round(F.col("value") / 2, 3))
    return table(spark, sf_dir, "events").select(*metrics.parse_log(line)).select("step", "seconds", "loss")


@query("WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT a.l_returnflag, a.l_linestatus, round((a.v / b.v - 1) * 100, 4) AS pct FROM g a LEFT JOIN g b ON a.l_linestatus = b.l_linestatus AND b.l_returnflag = 'R'")
def baseline_normalise(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("v"))
    base = g.where("l_returnflag = 'R'").select("l_linestatus", F.col("v").alias("b"))
    return g.join(base, "l_linestatus", "left").select("l_returnflag", "l_linestatus", F.round((F.col("v") / F.col("b") - 1) * 100, 4).alias("pct"))


@query("SELECT o_orderkey AS key, l_linenumber AS line, l_extendedprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS r FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE r = 1")
def first_occurrence_join(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("f"))
    return first.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("key"), F.col("f.l_linenumber").alias("line"), F.col("f.l_extendedprice").alias("price"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, rank::INTEGER AS rank FROM p WHERE rank <= 3")
def knn_l2_top3(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(v, v.where("vec_id % 20 = 0"), 3).select("query_id", "vec_id", "rank")


@query("""WITH RECURSIVE r AS (SELECT 0 AS step, 4 AS size, 0 AS seen UNION ALL
    SELECT step + 1, CASE WHEN size < 16 AND seen + size >= 20 THEN least(16, size + 4) ELSE size END, CASE WHEN size < 16 AND seen + size >= 20 THEN seen + size - 20 ELSE seen + size END FROM r WHERE step < 11)
  SELECT step::INTEGER AS step, size::INTEGER AS size FROM r""")
def rampup_batches(spark, sf_dir):
    return spark.createDataFrame(metrics.ramp_up(4, 16, 4, 60, 12), "step int, size int")


@query(f"WITH {IDX} SELECT idx AS step, round(CASE WHEN idx < 100 THEN 0.001::DOUBLE * idx / 100 WHEN idx < 1000 THEN 0.001::DOUBLE * (0.1 + 0.9 * 0.5 * (cos(pi() * (idx - 100) / 900) + 1)) ELSE 0 END, 9) AS lr FROM i")
def learning_rate(spark, sf_dir):
    return indexed_events(spark, sf_dir).select(F.col("idx").alias("step"), F.round(metrics.learning_rate(F.col("idx"), 0.001, 100, 1000), 9).alias("lr"))
