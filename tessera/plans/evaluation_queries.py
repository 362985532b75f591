"""Queries on sampling, evaluation, objectives and batches, with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, scoring, text
from ..operators import evaluation, ordering, retrieval, sequences
from .catalogue import CONV, DOCS, LAG, M, TIME_SQL, indexed_docs, kept_conversations, measurements, query, table, u, with_previous


def logits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("logit"))


LOGITS = "g AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS logit FROM lineitem)"
NEXT = "ORDER BY logit DESC, l_linenumber"


@query(f"WITH {LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey {NEXT}) AS rank FROM g) SELECT l_orderkey, l_linenumber, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def top_k_logits(spark, sf_dir):
    return evaluation.top_k(logits(spark, sf_dir), ["l_orderkey"], "logit", "l_linenumber", 3).select("l_orderkey", "l_linenumber", "rank")


@query(f"""WITH {LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY l_orderkey)) AS w FROM g),
  c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey {NEXT}) AS nr, count(*) OVER (PARTITION BY l_orderkey) AS n,
    sum(w) OVER (PARTITION BY l_orderkey {NEXT} ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY l_orderkey) AS upto FROM e),
  f AS (SELECT *, least(n, 1 + count(*) FILTER (WHERE upto < 0.83) OVER (PARTITION BY l_orderkey)) AS final FROM c),
  k AS (SELECT l_orderkey, max(logit) AS cut FROM f WHERE nr = final GROUP BY 1)
  SELECT l_orderkey, l_linenumber FROM f JOIN k USING (l_orderkey) WHERE logit >= cut""")
def nucleus_cutoff(spark, sf_dir):
    return evaluation.nucleus(logits(spark, sf_dir), ["l_orderkey"], "logit", "l_linenumber", 0.83).select("l_orderkey", "l_linenumber")


@query("SELECT event_type, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1")
def type_shares(spark, sf_dir):
    return evaluation.shares(table(spark, sf_dir, "events"), "event_type").withColumn("pct", F.round("pct", 6))


@query(f"""WITH {M}, {LAG}, t AS (SELECT unnest({TIME_SQL}) AS token FROM l) SELECT min(token)::INTEGER AS least, max(token)::INTEGER AS most, count(DISTINCT token) AS n FROM t""")
def vocabulary_coverage(spark, sf_dir):
    t = with_previous(measurements(spark, sf_dir)).select(F.explode(codec.time_block(F.col("sec"), F.col("prev"))).alias("token"))
    return t.agg(F.min("token").cast("int").alias("least"), F.max("token").cast("int").alias("most"), F.countDistinct("token").alias("n"))


@query(f"WITH {DOCS}, c AS (SELECT len(w)::INTEGER AS n, source FROM d), r AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, n) AS r FROM c GROUP BY source, n) SELECT source, n AS mode FROM r WHERE r = 1")
def length_mode(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("source", F.size(text.words(F.coalesce("text", F.lit("")))).alias("n")).groupBy("source", "n").count()
    return n.groupBy("source").agg(F.min(F.struct(-F.col("count"), "n")).alias("m")).select("source", F.col("m.n").alias("mode"))


@query(f"WITH {CONV} SELECT conv_id, CASE WHEN n_in <= 64 AND n_in + 3 * n_out <= 128 THEN 64 WHEN n_in <= 128 AND n_in + 3 * n_out <= 256 THEN 128 WHEN n_in <= 256 THEN 256 END::INTEGER AS bucket FROM f")
def two_threshold_buckets(spark, sf_dir):
    c = kept_conversations(spark, sf_dir)
    return c.select("conv_id", scoring.two_threshold_bucket(F.col("n_in"), F.col("n_out"), [64, 128, 256]).alias("bucket"))


@query("""WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system'),
  b AS (SELECT u.conv_id, u.i, u.text AS x, a.text AS y FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.i = a.i AND u.role = 'user' AND a.role = 'assistant')
  SELECT conv_id, (2 * i)::INTEGER AS pos, md5(x) AS digest FROM b UNION ALL SELECT conv_id, (2 * i + 1)::INTEGER, md5(y) FROM b""")
def combine_messages(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    said = lambda role: F.transform(F.filter("m", lambda x: x["role"] == role), lambda x: x["text"])
    return m.select("conv_id", F.posexplode(scoring.alternate(said("user"), said("assistant"))).alias("pos", "t")).select("conv_id", "pos", F.md5("t").alias("digest"))


@query("SELECT p_partkey AS id, len(list_filter(range(1, 9), lambda i: p_brand[:i] = 'Brand#23'[:i] AND length(p_brand) >= i))::BIGINT AS n FROM part")
def common_prefix(spark, sf_dir):
    letters = lambda x: F.split(x, "")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scoring.common_prefix(letters(F.col("p_brand")), letters(F.lit("Brand#23"))).alias("n"))


@query(f"""WITH {DOCS}, t AS (SELECT doc_id, flatten(list_transform(w, lambda x: CASE WHEN length(x) = 3 THEN [3, -2, -2] ELSE [length(x)] END)) AS t FROM d)
  SELECT doc_id, md5(array_to_string(list_concat(t, list_transform(range(1024), lambda i: 0))[1:1024], ' ')) AS tokens FROM t""")
def insert_sequence(spark, sf_dir):
    """Markers of whole texts replaced; the output's fixed length is the only cut."""
    t = F.transform(text.words(F.coalesce("text", F.lit(""))), F.length)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(scoring.insert_sequence(t, 3, [3, -2, -2], 1024).cast("array<string>"), " ")).alias("tokens"))


@query("""WITH q AS (SELECT l_orderkey, bool_or(l_quantity = 50) AS exact, bool_or(l_quantity >= 45) AS near FROM lineitem GROUP BY 1)
  SELECT count(*) AS questions, round(avg(exact::INTEGER) * 100, 6) AS exact_pct, round(avg(near::INTEGER) * 100, 6) AS near_pct FROM q""")
def any_pass_percent(spark, sf_dir):
    passes = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") == 50).alias("exact"), (F.col("l_quantity") >= 45).alias("near"))
    out = evaluation.any_pass(passes, ["l_orderkey"], ["exact", "near"])
    return out.select("questions", F.round("exact_pct", 6).alias("exact_pct"), F.round("near_pct", 6).alias("near_pct"))


@query("SELECT event_id, round(sum(value) OVER w / (sum(1 + event_id % 3) OVER w + 1e-8), 6) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_loss(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("weight", F.col("event_id") % 3 + 1)
    return evaluation.running_loss(e, ["user_id"], ["ts", "event_id"], "value", "weight").select("event_id", F.round("running", 6).alias("running"))


@query("SELECT event_id, max(event_id % 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_step FROM events")
def running_maximum(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.max(F.col("event_id") % 1000).over(w).alias("last_step"))


@query("SELECT event_type, round(sum(value * (event_id % 2)) / (sum(event_id % 2) + 1e-8), 6) AS mean FROM events GROUP BY 1")
def masked_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("mask", F.col("event_id") % 2)
    return evaluation.masked_mean(e, ["event_type"], "value", "mask").withColumn("mean", F.round("mean", 6))


OBJECTIVE = "o AS (SELECT l_orderkey, l_linenumber, l_tax - l_discount AS d, (l_quantity - 25) / 10 AS a FROM lineitem)"


@query(f"WITH {OBJECTIVE} SELECT l_orderkey, l_linenumber, round(least(exp(d) * a, least(greatest(exp(d), 0.95), 1.05) * a), 6) AS objective, round(exp(d) - d - 1, 6) AS kl FROM o")
def clipped_objective(spark, sf_dir):
    d, a = F.col("l_tax") - F.col("l_discount"), (F.col("l_quantity") - 25) / 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scoring.clipped_objective(d, a, 0.05), 6).alias("objective"), F.round(scoring.divergence_estimate(d), 6).alias("kl"))


@query(f"WITH {OBJECTIVE} SELECT l_orderkey, l_linenumber, round(ln(1 + exp(-0.1::DOUBLE * a)) * 0.9::DOUBLE + ln(1 + exp(0.1::DOUBLE * a)) * 0.1::DOUBLE, 6) AS loss FROM o")
def preference_loss(spark, sf_dir):
    loss = scoring.preference_loss((F.col("l_quantity") - 25) / 10, 0.1, 0.1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(loss, 6).alias("loss"))


@query("SELECT l_returnflag, round(avg((l_extendedprice > 30000)::INTEGER), 6) AS accuracy FROM lineitem GROUP BY 1")
def reward_accuracy(spark, sf_dir):
    better = (F.col("l_extendedprice") > 30000).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(better), 6).alias("accuracy"))


@query("SELECT s_nationkey, min(s_suppkey) AS smallest FROM supplier JOIN (SELECT s_nationkey, min(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1) USING (s_nationkey, s_acctbal) GROUP BY 1")
def smallest_of_group(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.groupBy("s_nationkey").agg(F.min(F.struct("s_acctbal", "s_suppkey")).alias("m")).select("s_nationkey", F.col("m.s_suppkey").alias("smallest"))


@query("WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) SELECT i - 1 AS idx, s_suppkey, c_custkey FROM s JOIN c USING (i)")
def positional_zip(spark, sf_dir):
    s = ordering.dense_index(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    c = ordering.dense_index(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").drop("c_acctbal")
    return evaluation.positional_zip(s, c)


@query(f"""WITH {DOCS}, k AS (SELECT doc_id, CASE WHEN len(w) <= 128 THEN 128 WHEN len(w) <= 256 THEN 256 WHEN len(w) <= 512 THEN 512 ELSE 1024 END AS class FROM d)
  SELECT row_number() OVER (ORDER BY class, {u('5', 'doc_id')}, doc_id) - 1 AS pos, doc_id, class::INTEGER AS class FROM k""")
def length_class_order(spark, sf_dir):
    n = F.size(text.words(F.coalesce("text", F.lit(""))))
    d = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"))
    d = d.select("doc_id", sequences.bucket_of(F.col("n"), [128, 256, 512, 1024]).alias("class"), ordering.unit_hash("5", F.col("doc_id")).alias("u"))
    return ordering.dense_index(d, "class", "u", "doc_id", name="pos").select("pos", "doc_id", "class")


@query(f"WITH {DOCS} SELECT (len(w) + 15) // 16 AS bucket, min(doc_id) AS doc_id FROM d GROUP BY 1")
def warmup_picks(spark, sf_dir):
    n = F.size(text.words(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").groupBy(F.ceil(n / 16).cast("long").alias("bucket")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT c_custkey, 1 AS weight FROM customer UNION ALL SELECT (SELECT min(c_custkey) FROM customer), 0 FROM range((SELECT (64 - count(*) % 64) % 64 FROM customer))")
def padded_eval(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return evaluation.pad_to_batches(c, c.count(), 64, "c_custkey")


@query(f"WITH {DOCS}, p AS (SELECT doc_id, (len(w) + 63) // 64 AS pages FROM d) SELECT doc_id, pages, (sum(pages) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - pages)::BIGINT AS first_page FROM p")
def page_allocation(spark, sf_dir):
    d = indexed_docs(spark, sf_dir).select("idx", "doc_id", F.ceil(F.col("n") / 64).cast("long").alias("pages"))
    return sequences.token_offsets(d, "pages").select("doc_id", "pages", F.col("offset").alias("first_page"))


@query("SELECT c_custkey, CASE WHEN c_custkey <= 100 THEN c_custkey ELSE ceil(c_custkey / ceil(c_custkey / 100) * 1.1::DOUBLE)::BIGINT END AS batch FROM customer")
def balanced_batch(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scoring.balanced_batch(F.col("c_custkey"), 100, 1.1).alias("batch"))


@query("WITH x AS (SELECT p_partkey AS id, list_transform(range(16), lambda i: i + p_size) AS x FROM part) SELECT id, array_to_string(list_concat(list_concat(x[1:4], x[13:16]), list_concat(x[5:8], x[9:12])), ' ') AS reordered FROM x")
def balanced_order(spark, sf_dir):
    x = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i + F.col("p_size"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x.alias("x"))
    return p.select("id", F.array_join(sequences.balanced_order(F.col("x"), 2).cast("array<string>"), " ").alias("reordered"))


@query("SELECT doc_id, sha256('v1|' || coalesce(source, '') || '|' || sha256(coalesce(text, ''))) AS key FROM documents")
def cache_keys(spark, sf_dir):
    """Keys of all documents; nulls count as empty."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", scoring.cache_key(F.coalesce("text", F.lit("")), F.lit("v1"), F.coalesce("source", F.lit(""))).alias("key"))


@query("SELECT s_suppkey, (s_suppkey % 8)::INTEGER AS number, 8 AS shards, 'train' AS stem, 'b' || s_nationkey AS bucket, 'p/' || s_suppkey AS prefix FROM supplier")
def name_parts(spark, sf_dir):
    stem, number, shards = scoring.shard_name(F.format_string("train-%05d-of-00008.parquet", F.col("s_suppkey") % 8))
    bucket, prefix = scoring.bucket_and_prefix(F.concat(F.lit("gs://b"), F.col("s_nationkey"), F.lit("/p/"), F.col("s_suppkey")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", number.alias("number"), shards.alias("shards"), stem.alias("stem"), bucket.alias("bucket"), prefix.alias("prefix"))


@query("""WITH p AS (SELECT a.vec_id AS query_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL)
  SELECT query_id, count(*) FILTER (WHERE d * d < 1.5) AS n_below FROM p GROUP BY 1""")
def knn_threshold(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    near = retrieval.within(v, v.where("vec_id % 20 = 0"), 1.5)
    return near.select("query_id", F.col("n").alias("n_below"))
