"""Queries on sampling, metrics, run summaries, orders and graphs, with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import evaluation, graph, metrics, ordering, sampling
from .catalogue import IDX, indexed_events, query, table, u
from .evaluation_queries import LOGITS, NEXT, logits
from .packing_queries import joined


@query(f"WITH {LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey {NEXT}) AS r FROM g) SELECT l_orderkey, l_linenumber FROM r WHERE r = 1")
def greedy_choice(spark, sf_dir):
    return sampling.sample(logits(spark, sf_dir), "greedy", ["l_orderkey"], "logit", "l_linenumber")


@query(f"""WITH {LOGITS}, n AS (SELECT *, round(logit / 0.7::DOUBLE - ln(-ln(greatest({u('draw', "l_orderkey || '|' || l_linenumber")}, 1e-12))), 9) AS noisy FROM g),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY noisy DESC, l_linenumber) AS r FROM n) SELECT l_orderkey, l_linenumber FROM r WHERE r = 1""")
def weighted_choice(spark, sf_dir):
    return sampling.sample(logits(spark, sf_dir), "weighted", ["l_orderkey"], "logit", "l_linenumber", seed="draw", temperature=0.7)


@query(f"""WITH {LOGITS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey {NEXT}) AS rank FROM g) WHERE rank <= 4),
  e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY l_orderkey)) AS w FROM k),
  b AS (SELECT *, (sum(w) OVER (PARTITION BY l_orderkey ORDER BY rank ROWS UNBOUNDED PRECEDING) - w) / sum(w) OVER (PARTITION BY l_orderkey) AS before FROM e)
  SELECT l_orderkey, l_linenumber, rank::INTEGER AS rank FROM b WHERE before < 0.83""")
def top_k_top_p(spark, sf_dir):
    return sampling.top_k_top_p(logits(spark, sf_dir), ["l_orderkey"], "logit", "l_linenumber", 4, 0.83).select("l_orderkey", "l_linenumber", "rank")


@query(f"""WITH {LOGITS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey {NEXT}) AS rank FROM g) WHERE rank <= 2)
  SELECT l_orderkey, l_linenumber, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY l_orderkey), 6) AS weight FROM k""")
def expert_routing(spark, sf_dir):
    r = sampling.routed(logits(spark, sf_dir), ["l_orderkey"], "logit", "l_linenumber", 2)
    return r.select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


@query(f"WITH {LOGITS} SELECT l_orderkey, l_linenumber, round(logit - ln(sum(exp(logit)) OVER (PARTITION BY l_orderkey)), 6) + 0.0 AS logp FROM g")
def log_probabilities(spark, sf_dir):
    r = sampling.log_probability(logits(spark, sf_dir), ["l_orderkey"], "logit")
    return r.select("l_orderkey", "l_linenumber", (F.round("logp", 6) + 0.0).alias("logp"))


RUN = "r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL)"


@query(f"""WITH {RUN} SELECT event_type AS run, count(*) AS steps, round(avg(value) FILTER (WHERE r <= 20), 6) AS last_avg, round(median(value) FILTER (WHERE r <= 20), 6) AS last_median, round(sum(value), 4) AS total, round(max_by(value, struct_pack(ts := ts, e := event_id)), 6) AS final,
  round(avg(value) FILTER (WHERE r <= 20) / 918.0::DOUBLE, 9) AS mfu FROM r GROUP BY 1""")
def run_summaries(spark, sf_dir):
    """Averages of a run's last steps and of all, and utilisation against the hardware's peak."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    last = metrics.last_n(e, ["event_type"], ["ts", "event_id"], "value", 20)
    every = e.groupBy("event_type").agg(F.count("*").alias("steps"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("final"))
    peak = F.lit(918.0)  # fixed value: peak TFLOP/s of one accelerator
    return every.join(last, "event_type").select(F.col("event_type").alias("run"), "steps", F.round("avg_v", 6).alias("last_avg"), F.round("median_v", 6).alias("last_median"), "total", "final", F.round(F.col("avg_v") / peak, 9).alias("mfu"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 4 // 4 WHEN n_nationkey % 3 = 1 THEN n_nationkey * 4 // 8 ELSE n_nationkey * 4 END::BIGINT AS nodes FROM nation")
def node_counts(spark, sf_dir):
    k = F.col("n_nationkey")
    device = F.when(k % 3 == 0, "v5p").when(k % 3 == 1, "a3mega").otherwise("cpu")
    return table(spark, sf_dir, "nation").select(k.alias("id"), scoring.node_count(device, k * 4).alias("nodes"))


@query("""WITH w AS (SELECT conv_id, turn, role, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n FROM conversations WHERE role <> 'system')
  SELECT role, count(*) AS turns, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean FROM w GROUP BY 1""")
def mean_tokens(spark, sf_dir):
    from ..functions import text

    n = F.size(text.words(F.coalesce("text", F.lit(""))))
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").select("role", n.cast("long").alias("n"))
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"))


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
  SELECT a.l_returnflag, a.l_linestatus, CASE WHEN b.v IS NULL THEN 'NA' ELSE printf('%.2f%%', (a.v / b.v - 1) * 100) END AS shown FROM g a LEFT JOIN g b ON a.l_linestatus = b.l_linestatus AND b.l_returnflag = 'R'""")
def shown_percents(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("v"))
    base = g.where("l_returnflag = 'R'").select("l_linestatus", F.col("v").alias("b"))
    shown = F.coalesce(F.format_string("%.2f%%", (F.col("v") / F.col("b") - 1) * 100), F.lit("NA"))
    return g.join(base, "l_linestatus", "left").select("l_returnflag", "l_linestatus", F.when(F.col("b").isNull(), "NA").otherwise(shown).alias("shown"))


@query("""WITH t AS (SELECT s_nationkey AS module, CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE s_suppkey % 6 END AS passed, CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE s_suppkey % 4 END AS failed FROM supplier)
  SELECT module, sum(passed)::BIGINT AS passed, sum(failed + CASE WHEN passed = 0 AND failed = 0 THEN 5 ELSE 0 END)::BIGINT AS failed, round(avg((passed > 0 AND failed = 0)::INTEGER), 6) AS file_accuracy FROM t GROUP BY 1""")
def test_tallies(spark, sf_dir):
    """Sums of a test runner's last lines; a file in which nothing ran counts as 5 failures."""
    k = F.col("s_suppkey")
    line = F.when(k % 11 == 0, "no tests ran").otherwise(F.format_string("== %d passed, %d failed in 0.1s ==", k % 6, k % 4))
    passed, failed = scoring.test_summary(line)
    t = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("module"), passed.alias("p"), failed.alias("f"))
    penalty = F.when((F.col("p") == 0) & (F.col("f") == 0), 5).otherwise(0)
    return t.groupBy("module").agg(F.sum("p").alias("passed"), F.sum(F.col("f") + penalty).alias("failed"), F.round(F.avg(((F.col("p") > 0) & (F.col("f") == 0)).cast("int")), 6).alias("file_accuracy"))


@query("""WITH g AS (SELECT event_id // 8 AS g, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY 1)
  SELECT round(avg(m), 6) AS reward, round(avg(s), 6) AS spread, round(avg(n), 6) AS length, count(*) AS groups FROM g""")
def policy_diagnostics(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 8).alias("g")).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    return g.agg(F.round(F.avg("m"), 6).alias("reward"), F.round(F.avg("s"), 6).alias("spread"), F.round(F.avg("n"), 6).alias("length"), F.count("*").alias("groups"))


@query("""WITH p AS (SELECT l_orderkey, max(l_extendedprice) FILTER (WHERE l_linenumber = 1) AS chosen, max(l_extendedprice) FILTER (WHERE l_linenumber = 2) AS rejected FROM lineitem GROUP BY 1)
  SELECT count(*) AS n, round(avg((chosen > rejected)::INTEGER), 6) AS accuracy FROM p WHERE chosen IS NOT NULL AND rejected IS NOT NULL""")
def preference_accuracy(spark, sf_dir):
    """Share of pairs whose chosen member scores higher."""
    of = lambda i: F.max(F.when(F.col("l_linenumber") == i, F.col("l_extendedprice")))
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of(1).alias("chosen"), of(2).alias("rejected")).where("chosen IS NOT NULL AND rejected IS NOT NULL")
    return p.agg(F.count("*").alias("n"), F.round(F.avg((F.col("chosen") > F.col("rejected")).cast("int")), 6).alias("accuracy"))


@query("""WITH c AS (SELECT p_partkey AS id, (p_size % 8 + 1)::BIGINT AS layers, (p_size % 5 + 1) * 64::BIGINT AS dim FROM part)
  SELECT id, layers * (4 * dim * dim + 3 * dim * 4 * dim + 2 * dim) + 2 * 1000 * dim AS parameters, 6 * 128 * (layers * (4 * dim * dim + 3 * dim * 4 * dim) + 1000 * dim) + 12 * layers * 128 * 128 * dim AS flops FROM c""")
def model_calculator(spark, sf_dir):
    """Parameters, and training operations of one sequence, of a decoder by layers and width."""
    layers, dim = (F.col("p_size") % 8 + 1).cast("long"), ((F.col("p_size") % 5 + 1) * 64).cast("long")
    parameters, flops = metrics.decoder_size(layers, dim, 1000, 128)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parameters.alias("parameters"), flops.alias("flops"))


@query("""WITH t AS (SELECT o_orderkey AS id, (o_custkey * 1000)::BIGINT AS tokens FROM orders) SELECT id, ceil(tokens / 4096.0)::BIGINT AS steps, greatest(1, ceil(ceil(tokens / 4096.0) * 0.1::DOUBLE))::BIGINT AS warmup, greatest(1, ceil(20000 / 4096.0))::BIGINT AS eval_every FROM t""")
def schedule_steps(spark, sf_dir):
    """Steps, warm-up and evaluation interval from numbers of tokens at 4096 tokens a step."""
    steps, warmup, interval = metrics.schedule(F.col("o_custkey") * 1000, 4096, 0.1, 20_000)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), steps.alias("steps"), warmup.alias("warmup"), interval.alias("eval_every"))


@query("SELECT event_id AS step, metric, round(value, 6) AS value FROM (SELECT event_id, value AS loss, value / 2 AS grad_norm FROM events) UNPIVOT (value FOR metric IN (loss, grad_norm))")
def long_metrics(spark, sf_dir):
    """Metrics of a step as a row each."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("value") / 2).alias("grad_norm"))
    return e.unpivot("step", ["loss", "grad_norm"], "metric", "value").where("value IS NOT NULL").select("step", "metric", F.round("value", 6).alias("value"))


@query("SELECT CASE event_type WHEN 'click' THEN 'perf/click' WHEN 'error' THEN 'perf/error' ELSE event_type END AS metric, event_id // 100 * 100 AS first_step, count(*) AS n FROM events GROUP BY 1, 2")
def metric_files(spark, sf_dir):
    """Metrics under exported names, by the file that holds their steps."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(metrics.exported_name(F.col("event_type"), {"click": "perf/click", "error": "perf/error"}).alias("metric"), (F.floor(F.col("event_id") / 100) * 100).alias("first_step")).agg(F.count("*").alias("n"))


@query(f"WITH {IDX}, t AS (SELECT count(*) AS c FROM events) SELECT (idx % 7)::INTEGER AS shard, count(*) AS length, printf('events-%05d-of-00007', idx % 7) AS name FROM i GROUP BY 1, 3")
def shard_manifest(spark, sf_dir):
    e = ordering.round_robin(indexed_events(spark, sf_dir), 7).groupBy(F.col("host").alias("shard")).agg(F.count("*").alias("length"))
    return e.select("shard", "length", F.format_string("events-%05d-of-00007", "shard").alias("name"))


@query("SELECT event_id AS step, lag(round(value, 6)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS written FROM events QUALIFY lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL")
def late_metrics(spark, sf_dir):
    """Each step writes the metrics of the one before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.lag(F.round("value", 6)).over(w).alias("written"), F.lag("event_id").over(w).alias("p"))
    return e.where("p IS NOT NULL").drop("p")


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ends FROM events),
  s AS (SELECT user_id, sum(ends - us)::BIGINT AS total, sum(CASE WHEN event_type = 'click' THEN ends - us ELSE 0 END)::BIGINT AS good FROM e WHERE ends IS NOT NULL GROUP BY 1)
  SELECT user_id, total, good, round(good / nullif(total, 0), 6) AS goodput FROM s""")
def goodput(spark, sf_dir):
    """Time spent in phases, a phase ending where the next begins, and the share of the productive one."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_type", us.alias("us"), F.lead(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ends")).where("ends IS NOT NULL")
    took = F.col("ends") - F.col("us")
    s = e.groupBy("user_id").agg(F.sum(took).alias("total"), F.sum(F.when(F.col("event_type") == "click", took).otherwise(0)).alias("good"))
    return s.withColumn("goodput", F.round(F.col("good") / F.nullif(F.col("total"), F.lit(0)), 6))


@query(f"SELECT s_suppkey, row_number() OVER (ORDER BY {u('9', 's_suppkey')}, s_suppkey) - 1 AS pos FROM supplier")
def file_shuffle(spark, sf_dir):
    """File names in an order given by a seed."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ordering.unit_hash("9", F.col("s_suppkey")).alias("u"))
    return ordering.dense_index(s, "u", "s_suppkey", name="pos").select("s_suppkey", "pos")


@query("""WITH p AS (SELECT p_partkey AS id, list_transform(range(6), lambda i: (i * 5 + p_size) % 7) AS a, list_transform(range(4), lambda i: 100 + i) AS b FROM part) SELECT id, 6 AS ordered, 4 AS mixed, 10 AS total FROM p""")
def kept_orders(spark, sf_dir):
    """Two lists merged by random places; the first one keeps its order. The counts of the merge's members that stand in order."""
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i * 5 + size) % 7).alias("a"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i + 100).alias("b"))
    m = p.withColumn("m", ordering.merge_in_order(F.col("a"), F.col("b"), "z", F.col("id")))
    first = F.filter("m", lambda x: x < 100)
    return m.select("id", F.when(first == F.col("a"), F.size(first)).alias("ordered"), F.size(F.filter("m", lambda x: x >= 100)).alias("mixed"), F.size("m").alias("total"))


@query("""WITH o AS (SELECT p_partkey AS id, p_size % 5 AS s1, length(p_name) AS s2 FROM part WHERE p_partkey % 4 <> 0) SELECT id, row_number() OVER (ORDER BY s1, s2, id) - 1 AS pos FROM o""")
def score_order(spark, sf_dir):
    """Names by a score of two parts; those already provided are left out."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("s1"), F.length("p_name").alias("s2"))
    given = p.where("id % 4 = 0").select("id")
    return ordering.dense_index(p.join(given, "id", "left_anti"), "s1", "s2", "id", name="pos").select("id", "pos")


@query("SELECT p_type AS policy, max(p_size) FILTER (WHERE p_size * length(p_type) <= 600) AS largest FROM part GROUP BY 1")
def largest_feasible(spark, sf_dir):
    """The largest batch of each policy that still fits."""
    fits = F.col("p_size") * F.length("p_type") <= 600
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("policy")).agg(F.max(F.when(fits, F.col("p_size"))).alias("largest"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity > 25 AS m FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, m ORDER BY l_linenumber, l_partkey) AS r FROM x)
  SELECT a.l_orderkey, a.l_linenumber AS slot, b.l_linenumber AS filled FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.m AND NOT b.m AND a.r = b.r""")
def masked_fill(spark, sf_dir):
    """The i-th masked place of a sequence gets the i-th row of the other kind."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") > 25).alias("m"))
    r = x.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey", "m").orderBy("l_linenumber", "l_partkey")))
    slots = r.where("m").select("l_orderkey", "r", F.col("l_linenumber").alias("slot"))
    return slots.join(r.where("not m").select("l_orderkey", "r", F.col("l_linenumber").alias("filled")), ["l_orderkey", "r"]).select("l_orderkey", "slot", "filled")


def dependencies(spark, sf_dir):
    """Edges from a part to the parts that need it: two smaller ones each, and a cycle of three."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    up = p.select(F.floor(F.col("k") / 2).alias("src"), F.col("k").alias("dst")).union(p.select(F.floor(F.col("k") / 3), "k")).where("src > 0 AND src < dst")
    loop = spark.createDataFrame([(7, 15), (15, 31), (31, 7)], "src long, dst long")
    return up, loop


EDGES = "e AS (SELECT DISTINCT * FROM (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part UNION ALL SELECT p_partkey // 3, p_partkey FROM part) WHERE src > 0 AND src < dst)"


@query(f"WITH RECURSIVE {EDGES}, l AS (SELECT src AS node, 0 AS level FROM e UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node) SELECT node, max(level)::INTEGER AS level FROM l GROUP BY 1")
def topological_levels(spark, sf_dir):
    return graph.topological_levels(dependencies(spark, sf_dir)[0])


@query(f"WITH RECURSIVE {EDGES}, l AS (SELECT 5::BIGINT AS node, 0 AS round UNION SELECT e.dst, l.round + 1 FROM l JOIN e ON e.src = l.node) SELECT node, min(round)::INTEGER AS round FROM l GROUP BY 1")
def graph_expansion(spark, sf_dir):
    start = spark.createDataFrame([(5,)], "node long")
    return graph.reachable(dependencies(spark, sf_dir)[0], start)


@query(f"""WITH RECURSIVE {EDGES}, a AS (SELECT src, dst FROM e UNION SELECT * FROM (VALUES (7::BIGINT, 15::BIGINT), (15, 31), (31, 7)) AS v(src, dst)),
  n AS (SELECT src AS node FROM a UNION SELECT dst FROM a), r AS (SELECT node AS x, node AS y FROM n UNION SELECT r.x, a.dst FROM r JOIN a ON a.src = r.y)
  SELECT f.x AS node, min(f.y) AS component FROM r f JOIN r b ON f.x = b.y AND f.y = b.x GROUP BY 1""")
def strong_components(spark, sf_dir):
    up, loop = dependencies(spark, sf_dir)
    return graph.strong_components(up.union(loop))


@query(f"SELECT joined_tokens FROM (SELECT string_agg(r_regionkey::VARCHAR, ' ' ORDER BY {u('1', 'r_regionkey')}, r_regionkey) AS joined_tokens FROM region)")
def shuffled_names(spark, sf_dir):
    r = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct(ordering.unit_hash("1", F.col("r_regionkey")).alias("u"), F.col("r_regionkey").alias("k")))).alias("r"))
    return r.select(joined(F.transform("r", lambda x: x["k"])).alias("joined_tokens"))
