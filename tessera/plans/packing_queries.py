"""Queries on packed, shifted, padded and batched token sequences, with SQL that states the same result. A document's tokens are
the lengths of its words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, text
from ..operators import metrics, ordering, packing, sequences
from .catalogue import DOCS, IDX, LAG, M, TIME_SQL, indexed_events, measurements, query, table, with_previous

V = "v AS (SELECT doc_id, idx, list_transform(w, lambda x: length(x)) AS v FROM d)"


def joined(c):
    return F.array_join(c.cast("array<string>"), " ")


def digest(c):
    return F.md5(joined(c))


def words_of(d):
    return text.words(F.coalesce(d["text"], F.lit("")))


def word_lengths(spark, sf_dir):
    """(doc_id, v): the tokens of every document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.transform(words_of(d), F.length).alias("v"))


def indexed_lengths(spark, sf_dir):
    return ordering.dense_index(word_lengths(spark, sf_dir), "doc_id")


@query(f"""WITH RECURSIVE {DOCS}, {V}, e AS (SELECT idx, v[1:64] AS v, len(v[1:64])::INTEGER AS n FROM v),
  f AS (SELECT idx, n, 0 AS bin, n AS used FROM e WHERE idx % 64 = 0
        UNION ALL SELECT e.idx, e.n, CASE WHEN f.used + e.n <= 64 THEN f.bin ELSE f.bin + 1 END, CASE WHEN f.used + e.n <= 64 THEN f.used + e.n ELSE e.n END FROM f JOIN e ON e.idx = f.idx + 1 AND e.idx % 64 <> 0),
  s AS (SELECT f.idx, f.idx // 64 AS block, bin, v, row_number() OVER (PARTITION BY f.idx // 64, bin ORDER BY f.idx) AS seg FROM f JOIN e ON f.idx = e.idx),
  g AS (SELECT block, bin, flatten(list(v ORDER BY idx)) AS v, flatten(list(range(len(v)) ORDER BY idx)) AS p, flatten(list(list_transform(v, lambda x: seg) ORDER BY idx)) AS s FROM s GROUP BY 1, 2),
  z AS (SELECT *, list_transform(range(64 - len(v)), lambda i: 0) AS z FROM g)
  SELECT block, bin, md5(array_to_string(list_concat(v, z), ' ')) AS packed, md5(array_to_string(list_concat(p, z), ' ')) AS positions, md5(array_to_string(list_concat(s, z), ' ')) AS segments FROM z""")
def packed_values(spark, sf_dir):
    p = packing.pack_greedily(indexed_lengths(spark, sf_dir), "v", 64)
    return p.select("block", "bin", digest(F.col("values")).alias("packed"), digest(F.col("positions")).alias("positions"), digest(F.col("segments")).alias("segments"))


@query(f"""WITH RECURSIVE {DOCS}, e AS (SELECT idx, least(len(w), 64)::INTEGER AS n FROM d),
  f AS (SELECT idx, 0::BIGINT AS bin, [n] AS used FROM e WHERE idx % 64 = 0
        UNION ALL SELECT idx, coalesce(i - 1, len(used))::BIGINT, CASE WHEN i IS NULL THEN list_append(used, n) ELSE list_transform(used, lambda x, j: x + CASE WHEN j = i THEN n ELSE 0 END) END
          FROM (SELECT e.idx, e.n, f.used, nullif(list_position(list_transform(f.used, lambda x: x + e.n <= 64), true), 0) AS i FROM f JOIN e ON e.idx = f.idx + 1 AND e.idx % 64 <> 0))
  SELECT idx // 64 AS block, bin::INTEGER AS bin, count(*) AS n_docs, sum(idx)::BIGINT AS ids FROM f GROUP BY 1, 2""")
def first_fit_packing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = ordering.dense_index(d.select("doc_id", F.least(F.size(words_of(d)), F.lit(64)).alias("n")), "doc_id")
    return packing.first_fit(d, 64).groupBy("block", "bin").agg(F.count("*").alias("n_docs"), F.sum("idx").alias("ids"))


@query(f"""WITH {DOCS}, {V}, t AS (SELECT idx, unnest(v) AS v, generate_subscripts(v, 1) AS p FROM v), g AS (SELECT v, row_number() OVER (ORDER BY idx, p) - 1 AS pos FROM t)
  SELECT pos // 1024 AS chunk, count(*)::INTEGER AS n, md5(string_agg(CASE WHEN pos % 1024 = 0 THEN 1 ELSE v END::VARCHAR, ' ' ORDER BY pos)) AS digest FROM g GROUP BY 1""")
def concat_with_start(spark, sf_dir):
    v = word_lengths(spark, sf_dir)
    sizes = ordering.dense_index(v.select("doc_id", F.size("v").cast("long").alias("n")), "doc_id")
    at = sequences.token_offsets(sizes, "n").select("doc_id", "offset")
    chunks = packing.concat_values(at.join(v, "doc_id"), "v", 1024, bos=1)
    return chunks.select("chunk", F.size("values").alias("n"), digest(F.col("values")).alias("digest"))


@query(f"""WITH {DOCS}, {V}, c AS (SELECT doc_id, v[1:96] AS v, list_transform(range(96 - len(v[1:96])), lambda i: 0) AS z FROM v)
  SELECT doc_id, len(v)::INTEGER AS true_length, md5(array_to_string(list_concat(v, z), ' ')) AS tokens, md5(array_to_string(list_concat(list_transform(v, lambda x: (x <> 0)::INTEGER), z), ' ')) AS segments, md5(array_to_string(list_concat(range(len(v)), z), ' ')) AS positions FROM c""")
def padded_columns(spark, sf_dir):
    d = word_lengths(spark, sf_dir).select("doc_id", F.slice("v", 1, 96).alias("v"))
    fill = lambda c: digest(sequences.pad_or_trim(c, 96))
    return d.select("doc_id", F.size("v").alias("true_length"), fill(F.col("v")).alias("tokens"), fill(sequences.segmentation(F.col("v"))).alias("segments"), fill(packing.positions(F.col("v"))).alias("positions"))


@query(f"""WITH {DOCS}, z AS (SELECT idx, list_transform(w, lambda x: length(x) % 5) AS v FROM d), g AS (SELECT idx // 128 AS "group", list_filter(flatten(list(v ORDER BY idx)), lambda x: x <> 0) AS v FROM z GROUP BY 1)
  SELECT "group", len(v)::INTEGER AS n, md5(array_to_string(v, ' ')) AS digest FROM g""")
def concat_documents(spark, sf_dir):
    d = indexed_lengths(spark, sf_dir).withColumn("v", F.transform("v", lambda x: x % 5))
    return packing.concat_groups(d, "v", 128).select("group", F.size("values").alias("n"), digest(F.col("values")).alias("digest"))


@query(f"""WITH {DOCS}, z AS (SELECT doc_id, list_transform(w, lambda x: length(x) % 5) AS v FROM d WHERE len(w) > 0), c AS (SELECT doc_id, v, unnest(range((len(v) + 99) // 100)) AS piece FROM z),
  p AS (SELECT doc_id, piece, list_filter(v[piece * 100 + 1 : piece * 100 + 100], lambda x: x <> 0) AS v FROM c) SELECT doc_id, piece::INTEGER AS piece, len(v)::INTEGER AS n, md5(array_to_string(v, ' ')) AS digest FROM p""")
def split_documents(spark, sf_dir):
    d = word_lengths(spark, sf_dir).where(F.size("v") > 0).select("doc_id", F.transform("v", lambda x: x % 5).alias("v"))
    n = F.ceil(F.size("v") / 100).cast("int")
    p = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(F.slice("v", i * 100 + 1, F.lit(100)), lambda x: x != 0))).alias("piece", "v"))
    return p.select("doc_id", "piece", F.size("v").alias("n"), digest(F.col("v")).alias("digest"))


@query(f"""WITH {DOCS}, {V}, s AS (SELECT doc_id, v, list_concat(v[2:], [1]) AS t FROM v WHERE len(v) > 0)
  SELECT doc_id, md5(array_to_string(v, ' ')) AS inputs, md5(array_to_string(t, ' ')) AS targets, list_sum(list_transform(t, lambda x: CASE WHEN x IN (0, 1) THEN 0 ELSE 1 END))::BIGINT AS weight FROM s""")
def next_token_rows(spark, sf_dir):
    d = word_lengths(spark, sf_dir).where(F.size("v") > 0)
    inputs, targets, segments = packing.next_tokens(F.col("v"))
    weight = F.aggregate(segments, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", digest(inputs).alias("inputs"), digest(targets).alias("targets"), weight.alias("weight"))


@query(f"WITH {DOCS}, {V}, c AS (SELECT doc_id, v[1:50] AS v FROM v) SELECT doc_id, len(v)::INTEGER AS n, md5(array_to_string(v[1:len(v) - 1], ' ')) AS inputs, md5(array_to_string(v[2:], ' ')) AS targets FROM c WHERE len(v) > 0")
def truncated_shift(spark, sf_dir):
    d = word_lengths(spark, sf_dir).select("doc_id", F.slice("v", 1, 50).alias("v")).where(F.size("v") > 0)
    n = F.size("v")
    return d.select("doc_id", n.alias("n"), digest(F.slice("v", F.lit(1), n - 1)).alias("inputs"), digest(F.slice("v", F.lit(2), n - 1)).alias("targets"))


@query(f"""WITH {M}, {LAG}, t AS (SELECT event_id, ts, {TIME_SQL} AS t FROM l), i AS (SELECT t, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM t),
  g AS (SELECT idx // 64 AS w, flatten(list(t ORDER BY idx))[1:256] AS t FROM i GROUP BY 1), z AS (SELECT *, list_transform(range(256 - len(t)), lambda i: 0) AS z FROM g)
  SELECT w, len(t)::INTEGER AS n, md5(array_to_string(list_concat(t, z), ' ')) AS tokens, md5(array_to_string(list_concat(list_transform(t, lambda x: 1), z), ' ')) AS segments FROM z""")
def window_records(spark, sf_dir):
    """Windows of 64 rows in time order as records of 256 tokens."""
    m = with_previous(measurements(spark, sf_dir)).select("event_id", "ts", codec.time_block(F.col("sec"), F.col("prev")).alias("t"))
    m = ordering.dense_index(m, "ts", "event_id")
    g = m.groupBy(F.floor(F.col("idx") / 64).alias("w")).agg(F.array_sort(F.collect_list(F.struct("idx", "t"))).alias("r"))
    g = g.select("w", F.slice(F.flatten(F.transform("r", lambda x: x["t"])), 1, 256).alias("t"))
    fill = lambda c: digest(sequences.pad_or_trim(c, 256))
    return g.select("w", F.size("t").alias("n"), fill(F.col("t")).alias("tokens"), fill(F.transform("t", lambda x: F.lit(1))).alias("segments"))


@query(f"""WITH RECURSIVE {DOCS}, e AS (SELECT idx // 256 AS block, CASE WHEN len(w) <= 64 THEN 64 WHEN len(w) <= 128 THEN 128 ELSE 256 END AS bucket, idx, least(len(w), 256)::INTEGER AS n FROM d),
  o AS (SELECT *, row_number() OVER (PARTITION BY block, bucket ORDER BY idx) AS r FROM e),
  f AS (SELECT block, bucket, r, n, 0 AS pack, n AS used, 1 AS seg FROM o WHERE r = 1
        UNION ALL SELECT o.block, o.bucket, o.r, o.n, CASE WHEN f.used + o.n <= 512 THEN f.pack ELSE f.pack + 1 END, CASE WHEN f.used + o.n <= 512 THEN f.used + o.n ELSE o.n END, CASE WHEN f.used + o.n <= 512 THEN f.seg + 2 ELSE 1 END FROM f JOIN o ON o.block = f.block AND o.bucket = f.bucket AND o.r = f.r + 1)
  SELECT block, bucket::INTEGER AS bucket, pack, count(*) AS prompts, sum(n)::BIGINT AS used, max(seg)::INTEGER AS last_segment FROM f GROUP BY 1, 2, 3""")
def prefill_packing(spark, sf_dir):
    """Prompts of a length class share prefill buffers of 512; every other segment number is left for the generated part."""
    d = table(spark, sf_dir, "documents")
    n = F.size(words_of(d))
    d = ordering.dense_index(d.select("doc_id", F.least(n, F.lit(256)).alias("n"), sequences.bucket_of(n, [64, 128, 256]).alias("bucket")), "doc_id")
    g = d.groupBy(F.floor(F.col("idx") / 256).alias("block"), "bucket").agg(F.array_sort(F.collect_list(F.struct("idx", "n"))).alias("r"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("pack"), F.array().cast("array<struct<pack:int,n:int>>").alias("out"))

    def step(a, x):
        fits = a["used"] + x["n"] <= 512
        pack = F.when(fits, a["pack"]).otherwise(a["pack"] + 1)
        return F.struct(F.when(fits, a["used"] + x["n"]).otherwise(x["n"]).alias("used"), pack.alias("pack"), F.concat(a["out"], F.array(F.struct(pack.alias("pack"), x["n"].alias("n")))).alias("out"))

    out = g.select("block", "bucket", F.explode(F.aggregate("r", start, step)["out"]).alias("o"))
    return out.groupBy("block", "bucket", F.col("o.pack").alias("pack")).agg(F.count("*").alias("prompts"), F.sum("o.n").alias("used"), (2 * F.count("*") - 1).cast("int").alias("last_segment"))


PAIRS = "p AS (SELECT p_partkey AS id, list_transform(range(p_size % 7 + 1), lambda i: (i + p_size) % 9 + 2) AS p, list_transform(range(p_size % 5 + 1), lambda i: (i * p_size) % 6 + 1) AS c FROM part)"


@query(f"""WITH {PAIRS}, r AS (SELECT *, len(p) + coalesce(nullif(list_position(c, 1), 0), len(c)) AS n FROM p),
  s AS (SELECT *, list_transform(range(16 - len(p) - len(c)), lambda i: 0) AS z FROM r)
  SELECT id, array_to_string(list_concat(list_concat(p, c), z), ' ') AS tokens, array_to_string(list_transform(range(16), lambda i: CASE WHEN i < n THEN i ELSE 0 END), ' ') AS positions,
    array_to_string(list_transform(range(16), lambda i: (i < n)::INTEGER), ' ') AS segments, array_to_string(list_transform(range(16), lambda i: (i >= len(p) - 1)::INTEGER), ' ') AS mask FROM s""")
def spliced_completions(spark, sf_dir):
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.transform(F.sequence(F.lit(0), size % 7), lambda i: (i + size) % 9 + 2).alias("p"), F.transform(F.sequence(F.lit(0), size % 5), lambda i: (i * size) % 6 + 1).alias("c")
    )
    parts = packing.spliced(F.col("p"), F.col("c"), 16, 1)
    return p.select("id", *(joined(x).alias(n) for x, n in zip(parts, ("tokens", "positions", "segments", "mask"))))


@query(f"WITH {IDX}, t AS (SELECT count(*) AS c FROM events) SELECT idx // ((c + 6) // 7) AS chunk, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM i, t GROUP BY 1")
def chunk_list(spark, sf_dir):
    e = indexed_events(spark, sf_dir)
    return e.groupBy(F.floor(F.col("idx") / -(-max(1, e.count()) // 7)).alias("chunk")).agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query(f"WITH {IDX}, t AS (SELECT count(*) AS c FROM events) SELECT idx // 50 AS \"group\", count(*) AS n, sum(event_id)::BIGINT AS ids FROM i, t WHERE c >= 200 AND idx < 200 GROUP BY 1")
def group_split(spark, sf_dir):
    """The first 4 groups of 50; none where there are too few rows."""
    e = indexed_events(spark, sf_dir)
    enough = F.lit(e.count() >= 200)
    return e.where(enough & (F.col("idx") < 200)).groupBy(F.floor(F.col("idx") / 50).alias("group")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"""WITH {IDX}, t AS (SELECT count(*) AS c FROM events), r AS (SELECT idx, event_id FROM i UNION ALL SELECT c + j, -1 FROM t, range(31) AS x(j) WHERE c + j < (c + 31) // 32 * 32)
  SELECT idx // 32 AS batch, count(*) AS n, sum(event_id)::BIGINT AS ids, count(*) FILTER (WHERE event_id = -1) AS pads FROM r GROUP BY 1""")
def padded_batches(spark, sf_dir):
    """Batches of 32; the last one is filled with rows of -1."""
    e = indexed_events(spark, sf_dir).select("idx", "event_id")
    n = e.count()
    pads = spark.range(n, -(-n // 32) * 32).select(F.col("id").alias("idx"), F.lit(-1).cast("long").alias("event_id"))
    return e.union(pads).groupBy(F.floor(F.col("idx") / 32).alias("batch")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum((F.col("event_id") == -1).cast("long")).alias("pads"))


@query(f"WITH {IDX} SELECT event_id, idx // 32 AS batch, (idx // 32 % 3)::INTEGER AS source, idx // 128 AS step, (idx % 32 // 8)::INTEGER AS device FROM i")
def batch_places(spark, sf_dir):
    """Batches of 32 in turn from 3 iterators, 4 batches in a step, each cut over 4 devices."""
    batch = F.floor(F.col("idx") / 32)
    return indexed_events(spark, sf_dir).select("event_id", batch.alias("batch"), F.pmod(batch, F.lit(3)).cast("int").alias("source"), F.floor(F.col("idx") / 128).alias("step"), F.floor(F.col("idx") % 32 / 8).cast("int").alias("device"))


@query(f"WITH {IDX} SELECT idx // 40 AS batch, sum(event_id)::BIGINT AS ids FROM i WHERE idx // 40 < 12 GROUP BY 1")
def sub_batches(spark, sf_dir):
    return indexed_events(spark, sf_dir).where("idx < 480").groupBy(F.floor(F.col("idx") / 40).alias("batch")).agg(F.sum("event_id").alias("ids"))


@query(f"""WITH {DOCS}, {V}, s AS (SELECT idx, doc_id, len(v) AS n, CASE WHEN len(v) <= 1 THEN 1 ELSE (2 ** ceil(log2(len(v))))::BIGINT END AS padded FROM v)
  SELECT row_number() OVER (ORDER BY padded, doc_id) - 1 AS pos, doc_id, padded::INTEGER AS padded FROM s""")
def padded_length_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", text.next_power_of_two(F.size(words_of(d))).cast("int").alias("padded"))
    return ordering.dense_index(d, "padded", "doc_id", name="pos").select("pos", "doc_id", "padded")


@query(f"WITH {IDX}, p AS (SELECT event_id, event_id % 7 AS pos, idx FROM i) SELECT event_id, (sum((pos = 0)::INTEGER) OVER (PARTITION BY idx // 512 ORDER BY idx ROWS UNBOUNDED PRECEDING) * (event_id % 3 <> 0)::INTEGER)::BIGINT AS segment FROM p")
def segment_ids(spark, sf_dir):
    """Within rows of 512 tokens: the number of position zeros up to each token, 0 for pads."""
    from pyspark.sql import Window

    e = indexed_events(spark, sf_dir)
    starts = F.sum((F.col("event_id") % 7 == 0).cast("long")).over(Window.partitionBy(F.floor(F.col("idx") / 512)).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", (starts * (F.col("event_id") % 3 != 0).cast("long")).alias("segment"))


@query(f"WITH {DOCS} SELECT sum(len(list_filter(w, lambda x: length(x) <> 3)))::BIGINT AS weight, count(*) AS rows_seen FROM d")
def target_weight(spark, sf_dir):
    """Targets that count: those that aren't pads (here words of three letters)."""
    v = word_lengths(spark, sf_dir)
    return v.agg(F.sum(F.size(F.filter("v", lambda x: x != 3))).alias("weight"), F.count("*").alias("rows_seen"))
