"""Queries on records, conversations, templates and text values, with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, text
from ..operators import columns, sequences
from .catalogue import DOCS, LAG, M, TIME_SQL, measurements, query, table, with_previous
from .packing_queries import digest, joined, word_lengths, words_of


def chat(spark, sf_dir):
    """(conv_id, m): the messages of every conversation in turn order."""
    c = table(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    return m.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))


@query("SELECT c_custkey, c_name FROM customer")
def kept_columns(spark, sf_dir):
    return columns.keep(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "no_such_column"])


@query("SELECT c_acctbal, c_custkey AS id, c_name AS inputs, c_name AS targets FROM customer")
def rekeyed_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return columns.rekey(c, {"id": "c_custkey", "inputs": "c_name", "targets": "c_name"})


@query("SELECT p_partkey AS id, p_name AS targets FROM part")
def renamed_columns(spark, sf_dir):
    return columns.rename_or_drop(table(spark, sf_dir, "part"), {"id": "p_partkey", "targets": "p_name", "inputs": None})


@query("SELECT md5(text) AS inputs, md5(text) AS targets FROM documents")
def duplicated_text(spark, sf_dir):
    return columns.inputs_and_targets(table(spark, sf_dir, "documents").select(F.md5("text").alias("text")), "text")


@query("SELECT p_partkey AS id, array_to_string(list_filter([p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END, p_name], lambda x: x IS NOT NULL)[1:2], '|') AS merged FROM part")
def merged_columns(spark, sf_dir):
    parts = [F.array("p_brand"), F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.col("p_name"))]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(columns.merged(parts, 2), "|").alias("merged"))


@query("SELECT s_suppkey, s_name AS name FROM supplier")
def decoded_feature(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.encode("s_name", "UTF-8")).alias("x"))
    return s.select("s_suppkey", columns.first_text(F.col("x")).alias("name"))


@query("SELECT p_partkey AS id, p_size::BIGINT AS tokens, 1 AS tokens_segmentation, 0 AS tokens_position FROM part")
def reshaped_packing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_size").cast("long").alias("values"), F.lit(1).alias("segments"), F.lit(0).alias("positions")).alias("tokens"))
    return columns.reshaped_packing(p, ["tokens"])


QA = "q AS (SELECT p_partkey AS id, ' ' || p_name || ' {answer} ' AS question, CASE p_partkey % 3 WHEN 0 THEN p_type || ' #### ' || p_size WHEN 1 THEN p_type ELSE 'a #### b #### c' END AS answer FROM part)"


def questions(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    answer = F.when(k == 0, F.concat("p_type", F.lit(" #### "), "p_size")).when(k == 1, F.col("p_type")).otherwise("a #### b #### c")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_name", F.lit(" {answer} ")).alias("question"), answer.alias("answer"))


@query(f"""WITH {QA} SELECT id, 'Q {{q}}: ' || trim(question) AS asked, CASE id % 3 WHEN 0 THEN '[' || trim(split_part(answer, '####', 1)) || '] so ' || trim(split_part(answer, '####', 2)) ELSE answer END AS said FROM q""")
def qa_conversation(spark, sf_dir):
    m = text.qa_conversation(F.col("question"), F.col("answer"), "Q {{q}}: {question}", "[{reasoning}] so {answer}")
    return questions(spark, sf_dir).select("id", m[0]["content"].alias("asked"), m[1]["content"].alias("said"))


@query(f"WITH {QA} SELECT id, trim(question) AS asked, CASE WHEN id % 3 = 0 THEN trim(split_part(answer, '####', 1)) END AS reasoning, CASE WHEN id % 3 = 0 THEN trim(split_part(answer, '####', 2)) END AS final, CASE id % 3 WHEN 0 THEN trim(split_part(answer, '####', 2)) WHEN 2 THEN 'b' END AS hashed FROM q")
def reasoning_split(spark, sf_dir):
    reasoning, final = text.split_once(F.col("answer"), "####")
    return questions(spark, sf_dir).select("id", text.strip(F.col("question")).alias("asked"), reasoning.alias("reasoning"), final.alias("final"), text.hash_answer(F.col("answer")).alias("hashed"))


@query("SELECT p_partkey AS id, array_to_string(list_distinct(['n' || p_size, 'name']), ',') AS names FROM part WHERE false UNION ALL SELECT p_partkey, 'n' || p_size || ',name' FROM part")
def template_names(spark, sf_dir):
    t = F.concat(F.lit("{n"), "p_size", F.lit("} {{not}} {name} and {name} {no name}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.template_names(t), ",").alias("names"))


CHAT = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS content FROM conversations), r AS (SELECT *, '<' || role || '>' || content || '</' || role || '>' || chr(10) AS r FROM c)"


@query(f"WITH {CHAT}, p AS (SELECT conv_id, role, r, coalesce(string_agg(r, '') OVER (PARTITION BY conv_id ORDER BY turn, role, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prompt FROM r) SELECT conv_id, md5(prompt) AS prompt, md5(r) AS completion FROM p WHERE role = 'assistant'")
def chat_template(spark, sf_dir):
    c = chat(spark, sf_dir).select("conv_id", F.explode(text.prompt_and_completion(F.col("m"))).alias("x"))
    return c.select("conv_id", F.md5("x.prompt").alias("prompt"), F.md5("x.completion").alias("completion"))


@query(f"""WITH {CHAT}, w AS (SELECT *, list_transform(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> ''), lambda x: length(x)) AS t FROM c),
  g AS (SELECT conv_id, flatten(list(t ORDER BY turn, role, content))[1:64] AS inputs, flatten(list(CASE WHEN role = 'assistant' THEN t ELSE list_transform(t, lambda x: 0) END ORDER BY turn, role, content))[1:64] AS targets FROM w GROUP BY 1)
  SELECT conv_id, len(inputs)::INTEGER AS n, md5(array_to_string(inputs, ' ')) AS inputs, md5(array_to_string(targets, ' ')) AS targets FROM g""")
def masked_prompts(spark, sf_dir):
    """Inputs and targets of conversations, cut at 64 tokens; tokens of prompts count as unknown (0) in the targets."""
    c = chat(spark, sf_dir).withColumn("t", F.transform("m", lambda x: F.transform(text.words(x["content"]), F.length)))
    targets = sequences.prompt_mask(F.col("t"), F.transform("m", lambda x: x["role"] != "assistant"), 0)
    inputs, targets = F.slice(F.flatten("t"), 1, 64), F.slice(targets, 1, 64)
    return c.select("conv_id", F.size(inputs).alias("n"), digest(inputs).alias("inputs"), digest(targets).alias("targets"))


@query(f"""WITH {CHAT}, w AS (SELECT *, len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS n FROM c),
  f AS (SELECT conv_id, (list(n ORDER BY turn, content) FILTER (WHERE role = 'user'))[1] AS n_in, (list(n ORDER BY turn, content) FILTER (WHERE role = 'assistant'))[1] AS n_out FROM w GROUP BY 1)
  SELECT conv_id, n_in::INTEGER AS n_in, least(64, n_out)::INTEGER AS max_output FROM f WHERE n_in <= 32 AND n_out IS NOT NULL""")
def prompt_length_filter(spark, sf_dir):
    """First prompt and completion of each conversation; prompts of over 32 tokens go, completions end with the target's room."""
    first = lambda role: F.size(text.words(F.get(F.filter("m", lambda x: x["role"] == role), F.lit(0))["content"]))
    has = lambda role: F.exists("m", lambda x: x["role"] == role)
    c = chat(spark, sf_dir).where(has("user") & has("assistant")).select("conv_id", first("user").alias("n_in"), first("assistant").alias("n_out"))
    return c.where("n_in <= 32").select("conv_id", "n_in", F.least(F.lit(64), F.col("n_out")).alias("max_output"))


@query("SELECT conv_id, array_to_string(list(md5(coalesce(text, '')) ORDER BY turn, text) FILTER (WHERE role = 'assistant'), ' ') AS responses FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'assistant') > 0")
def responses_per_prompt(spark, sf_dir):
    said = F.transform(F.filter("m", lambda x: x["role"] == "assistant"), lambda x: F.md5(x["content"]))
    return chat(spark, sf_dir).select("conv_id", F.array_join(said, " ").alias("responses")).where("responses <> ''")


@query("WITH g AS (SELECT p_partkey AS id, p_name, g FROM part, range(2) AS r(g)) SELECT id, g::INTEGER AS generation, 'user' AS prompt_role, p_name AS prompt, 'assistant' AS completion_role, p_name || ' ' || g AS actual_completion FROM g")
def distillation_records(spark, sf_dir):
    message = lambda role, x: F.array(F.struct(F.lit(role).alias("role"), x.alias("content")))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), message("user", F.col("p_name")).alias("prompt"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda g: F.concat("p_name", F.lit(" "), g.cast("string")))).alias("generation", "text"))
    p = p.select("id", "generation", "prompt", message("assistant", F.col("text")).alias("actual"))
    return p.select("id", "generation", F.col("prompt")[0]["role"].alias("prompt_role"), F.col("prompt")[0]["content"].alias("prompt"), F.col("actual")[0]["role"].alias("completion_role"), F.col("actual")[0]["content"].alias("actual_completion"))


@query("SELECT p_partkey AS id, array_to_string(list_concat(list_transform(range(p_size % 4 + 1), lambda i: i), [p_size, p_size + 1]), ' ') AS tokens FROM part")
def result_records(spark, sf_dir):
    """Prompt tokens up to their true length, then what was generated."""
    n = F.col("p_size") % 4 + 1
    prompt = sequences.pad_or_trim(F.sequence(F.lit(0), n - 1), 8)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), joined(F.concat(F.slice(prompt, F.lit(1), n), F.array(F.col("p_size"), F.col("p_size") + 1))).alias("tokens"))


@query("SELECT doc_id, length(trim(text, E' \\n\\t\\r\\x0b\\x0c')) AS n FROM documents WHERE trim(text, E' \\n\\t\\r\\x0b\\x0c') <> ''")
def non_empty_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.strip(F.col("text")).alias("t"))
    return d.where("t <> ''").select("doc_id", F.length("t").cast("long").alias("n"))


@query("SELECT o_orderkey AS id, o_custkey AS value FROM orders WHERE o_orderkey % 5 <> 0")
def parsed_rows(spark, sf_dir):
    """Rows that can't be parsed are left out."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), "o_custkey")).otherwise(F.col("o_custkey").cast("string")).alias("raw"))
    return o.select("id", F.col("raw").try_cast("long").alias("value")).where("value IS NOT NULL")


@query("SELECT date_diff('day', min(ts), max(ts)) < 1 OR min(ts) IS NULL AS too_short, date_part('day', max(ts) - min(ts))::INTEGER AS days FROM events")
def quality_gate(spark, sf_dir):
    span = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    e = table(spark, sf_dir, "events").agg(span.alias("us"))
    days = F.floor(F.col("us") / 86_400_000_000)
    return e.select((F.col("us").isNull() | (days < 1)).alias("too_short"), days.cast("int").alias("days"))


@query("SELECT l_orderkey AS batch, count(*) FILTER (WHERE l_linenumber % 3 <> 0) > 0 AS real FROM lineitem GROUP BY 1")
def real_batches(spark, sf_dir):
    """A batch is real if it has a value above -1."""
    x = F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(F.col("l_linenumber"))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.collect_list(x).alias("x"))
    return g.select("batch", F.exists("x", lambda v: v > -1).alias("real"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def cache_hits(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(wanted, "id", "left_semi")


@query("SELECT l_orderkey AS request, array_to_string(list(l_linenumber ORDER BY l_linenumber, l_partkey), ' ') AS stream, max(l_linenumber)::INTEGER AS last FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def request_streams(spark, sf_dir):
    """The answers of each request, collected in the order in which they came."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"), F.max("l_linenumber").cast("int").alias("last"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"))
    return parts.join(known, "request", "left_semi").select("request", joined(F.transform("r", lambda x: x["l_linenumber"])).alias("stream"), "last")


FORMAT = "f AS (SELECT p_partkey AS id, p_size, CASE p_partkey % 4 WHEN 0 THEN ' <r>why' || chr(10) || 'so</r> <a>' || p_size || '</a> ' WHEN 1 THEN '<r>why</r><a>about ' || p_size || '.5 or 7</a>' WHEN 2 THEN '<r></r><a>1</a>' ELSE 'x <r>why</r><a>$1,' || (100 + p_size % 900) || '</a>' END AS said FROM part)"


def formatted(spark, sf_dir):
    p, k, size = table(spark, sf_dir, "part"), F.col("p_partkey") % 4, F.col("p_size").cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit(" <r>why\nso</r> <a>"), size, F.lit("</a> "))).when(k == 1, F.concat(F.lit("<r>why</r><a>about "), size, F.lit(".5 or 7</a>")))
        .when(k == 2, "<r></r><a>1</a>").otherwise(F.concat(F.lit("x <r>why</r><a>$1,"), (F.col("p_size") % 900 + 100).cast("string"), F.lit("</a>")))
    )
    return p.select(F.col("p_partkey").alias("id"), "p_size", said.alias("said"))


@query(f"WITH {FORMAT} SELECT id, CASE id % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'about ' || p_size || '.5 or 7' END AS held, CASE WHEN id % 4 < 2 THEN 3.0 ELSE 0.0 END::DOUBLE AS reward FROM f")
def exact_format(spark, sf_dir):
    held = text.exact_format(F.col("said"), ("<r>", "</r>"), ("<a>", "</a>"))
    return formatted(spark, sf_dir).select("id", held.alias("held"), F.when(held.isNotNull(), 3.0).otherwise(0.0).alias("reward"))


@query(f"WITH {FORMAT} SELECT id, CASE WHEN id % 4 = 0 OR (id % 4 = 2 AND p_size = 1) OR (id % 4 = 3 AND p_size = 1) THEN 1.5 ELSE 0.0 END::DOUBLE AS reward FROM f")
def number_reward(spark, sf_dir):
    return formatted(spark, sf_dir).select("id", text.number_reward(F.col("said"), "<a>", F.col("p_size").cast("string")).alias("reward"))


@query(f"""WITH {FORMAT}, n AS (SELECT id, p_size, CASE id % 4 WHEN 0 THEN p_size::DOUBLE WHEN 2 THEN 1.0 WHEN 3 THEN 1000.0 + 100 + p_size % 900 END AS g FROM f)
  SELECT id, coalesce(g = p_size, false) AS correct, coalesce(p_size <> 0 AND g / p_size BETWEEN 0.9 AND 1.1, false) AS near, id % 4 = 0 AS formed FROM n""")
def response_score(spark, sf_dir):
    said = F.regexp_extract("said", "(?s)<a>(.+?)</a>", 1)
    formed = text.exact_format(F.col("said"), ("<r>", "</r>"), ("<a>", "</a>")).isNotNull()
    correct, near, well = text.response_flags(said, F.col("p_size").cast("string"), formed)
    return formatted(spark, sf_dir).select("id", correct.alias("correct"), near.alias("near"), well.alias("formed"))


@query(f"""WITH {FORMAT}, n AS (SELECT id, p_size, CASE id % 4 WHEN 0 THEN p_size::DOUBLE WHEN 2 THEN 1.0 WHEN 3 THEN 1000.0 + 100 + p_size % 900 END AS g FROM f)
  SELECT count(*) AS n, round(100 * avg(coalesce(g = p_size, false)::INTEGER), 6) AS accuracy, round(100 * avg(coalesce(p_size <> 0 AND g / p_size BETWEEN 0.9 AND 1.1, false)::INTEGER), 6) AS near_accuracy, round(100 * avg((id % 4 = 0)::INTEGER), 6) AS format_accuracy FROM n""")
def evaluation_percentages(spark, sf_dir):
    pct = lambda c: F.round(F.avg(F.col(c).cast("int")) * 100, 6)
    return response_score(spark, sf_dir).agg(F.count("*").alias("n"), pct("correct").alias("accuracy"), pct("near").alias("near_accuracy"), pct("formed").alias("format_accuracy"))


@query("""WITH s AS (SELECT o_orderkey AS id, (o_orderkey * o_orderkey % 400000)::BIGINT AS s FROM orders) SELECT id,
  CASE WHEN s < 60 THEN printf('%.1fs', s::DOUBLE) WHEN s < 3600 THEN printf('%.1fm', floor(s / 6) / 10) WHEN s < 86400 THEN printf('%.1fh', floor(s / 360) / 10) ELSE printf('%dd %dh', s // 86400, s % 86400 // 3600) END AS shown FROM s""")
def shown_durations(spark, sf_dir):
    s = F.col("o_orderkey") * F.col("o_orderkey") % 400000
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.duration(s).alias("shown"))


@query("SELECT p_partkey AS id, p_size AS size, p_size / 2 AS half, p_size % 2 = 0 AS even, p_brand AS brand FROM part")
def tuning_parameters(spark, sf_dir):
    size = F.col("p_size")
    raw = F.concat(F.lit("{size: "), size.cast("string"), F.lit(", half: "), (size / 2).cast("string"), F.lit(", 'even': "), F.when(size % 2 == 0, "yes").otherwise("no"), F.lit(", brand: '"), "p_brand", F.lit("'}"))
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.parameters(raw).alias("m"))
    return m.select("id", F.col("m")["size"].try_cast("int").alias("size"), F.col("m")["half"].try_cast("double").alias("half"), text.truth_value(F.col("m")["even"]).alias("even"), F.col("m")["brand"].alias("brand"))


@query("SELECT p_partkey AS id, (SELECT string_agg(i::VARCHAR, ' ' ORDER BY i) FROM range(1, p_size + 1) AS r(i) WHERE p_size % i = 0) AS divisors FROM part")
def divisors(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), joined(text.divisors(F.col("p_size"))).alias("divisors"))


@query("SELECT p_partkey AS id, (3 + 144 + CASE WHEN (p_size % 4 + 1) * (p_size % 3 + 1) > 1 THEN (p_size % 4 + 1) * (p_size % 3 + 1) * 145 ELSE 0 END)::BIGINT AS n FROM part")
def image_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.tile_tokens(F.col("p_size") % 4 + 1, F.col("p_size") % 3 + 1, 144).cast("long").alias("n"))


@query("SELECT p_partkey AS id, array_to_string([p_size % 50 + 1, 101, 102, 3, 201, 5], ' ') AS tokens FROM part")
def spliced_images(spark, sf_dir):
    x = F.array(F.col("p_size") % 50 + 1, F.lit(99), F.lit(3), F.lit(99), F.lit(5), F.lit(99))
    parts = F.array(F.array(F.lit(101), F.lit(102)), F.array(F.lit(201)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), joined(text.spliced_at(x, 99, parts)).alias("tokens"))


@query("SELECT p_partkey AS id, repeat('<img>', greatest(0, p_size % 4 - p_size % 2)::INTEGER) || repeat('<img>', (p_size % 2)::INTEGER) || p_name AS prompt FROM part")
def image_prompts(spark, sf_dir):
    prompt = F.concat(F.repeat(F.lit("<img>"), (F.col("p_size") % 2).cast("int")), F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.with_images(prompt, "<img>", F.col("p_size") % 4).alias("prompt"))


@query("SELECT p_partkey AS id, p_name AS one, p_name || '|' || p_brand AS two, 'b a' AS tokens FROM part")
def normalised_prompts(spark, sf_dir):
    names = F.array(F.lit("a"), F.lit("b"))
    one, two = text.normalised_prompts(F.col("p_name"), "text"), text.normalised_prompts(F.array("p_name", "p_brand"), "texts")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), one[0].alias("one"), F.array_join(two, "|").alias("two"), text.normalised_prompts(F.array(F.lit(1), F.lit(0)), "tokens", names)[0].alias("tokens"))


@query("""WITH p AS (SELECT event_id, (event_id % 65536)::BIGINT AS a, (user_id % 65536)::BIGINT AS b FROM events)
  SELECT event_id, array_to_string([3, 32 + 11, 1 + 11, 13 + 11, 184 + 11, 11, 11, 11, 11, 11, 11, 11, 11, a // 256 + 11, a % 256 + 11, b // 256 + 11, b % 256 + 11], ' ') AS tokens FROM p""")
def ipv6_tokens(spark, sf_dir):
    part = lambda c: F.lower(F.hex(F.col(c) % 65536))
    address = F.concat(F.lit("2001:db8::"), part("event_id"), F.lit(":"), part("user_id"))
    return table(spark, sf_dir, "events").select("event_id", joined(codec.merged_address(address, F.lit(6), True)).alias("tokens"))


@query("SELECT event_id, event_id % 3 <> 0 AS valid FROM events")
def valid_tokens(spark, sf_dir):
    t = F.array(F.lit(0), F.lit(266), F.when(F.col("event_id") % 3 == 0, 267).otherwise(11))
    return table(spark, sf_dir, "events").select("event_id", codec.valid_tokens(t).alias("valid"))


@query(f"WITH {DOCS} SELECT doc_id, -abs(20 - (1 + len(list_filter(w, lambda x: length(x) > 4))))::BIGINT AS reward FROM d")
def length_reward(spark, sf_dir):
    return word_lengths(spark, sf_dir).select("doc_id", (-F.abs(20 - (1 + F.size(F.filter("v", lambda x: x > 4))))).cast("long").alias("reward"))


@query(f"WITH {DOCS} SELECT doc_id, md5(array_to_string(w, chr(10))) AS prepared FROM d")
def sentence_lines(spark, sf_dir):
    """A text stripped, with one part on each line, as a summary scorer wants its sentences."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.array_join(words_of(d), "\n")).alias("prepared"))


@query(f"""WITH {M}, {LAG}, r AS (SELECT *, greatest(1, floor(rtt * 1000.0))::BIGINT AS us FROM l), x AS (SELECT *, least(31, greatest(0, length(bin(us)) - 11)) AS ex FROM r),
  w AS (SELECT *, (ex * 2048 + least(2047, floor(us / power(2, ex))))::BIGINT AS word FROM x)
  SELECT event_id, array_to_string(list_sort(list_concat(list_concat(list_concat([0, 1], list_transform(string_split(src, '.'), lambda o: o::BIGINT + 11)), list_concat([2], list_transform(string_split(dst, '.'), lambda o: o::BIGINT + 11))),
  list_concat(CASE WHEN rtt < 0 THEN [10] ELSE [8, word // 256 + 11, word % 256 + 11] END, {TIME_SQL}))), ' ') AS sorted_tokens FROM w""")
def shuffled_blocks(spark, sf_dir):
    """Measurements with their blocks in shuffled order. SQL can't follow the shuffle: the tokens come sorted."""
    t = codec.shuffled_measurement(*map(F.col, ("src", "dst", "rtt", "sec", "prev")), F.lit(4))
    m = with_previous(measurements(spark, sf_dir)).select("event_id", t.alias("t"))
    return m.select("event_id", joined(F.array_sort("t")).alias("sorted_tokens"))


@query("SELECT o_orderkey AS id, array_to_string([CASE WHEN o_custkey % 40000 BETWEEN 0 AND 32000 THEN o_custkey % 40000 ELSE 1 END, -5, o_orderkey], ' ') AS numbers FROM orders")
def hex_results(spark, sf_dir):
    """Token ids from a hex log; a first one outside the vocabulary becomes 1."""
    low = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    turned = lambda h: F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    raw = F.concat(turned(low(F.col("o_custkey") % 40000)), F.lit("fbffffff"), turned(low(F.col("o_orderkey"))))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.hex_numbers(raw).alias("n"))
    first = F.when(F.col("n")[0].between(0, 32000), F.col("n")[0]).otherwise(1)
    return o.select("id", joined(F.concat(F.array(first), F.slice("n", F.lit(2), F.size("n") - 1))).alias("numbers"))


FIRST = """p AS (SELECT conv_id, list_filter(string_split_regex((list(coalesce(text, '') ORDER BY turn, coalesce(text, '')) FILTER (WHERE role = 'user'))[1], '\s+'), lambda x: x <> '') AS a,
  list_filter(string_split_regex((list(coalesce(text, '') ORDER BY turn, coalesce(text, '')) FILTER (WHERE role = 'assistant'))[1], '\s+'), lambda x: x <> '') AS b FROM conversations GROUP BY 1)"""


@query(f"""WITH {FIRST}, o AS (SELECT a, b, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS o FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
  SELECT count(*) AS n, round(100 * avg(CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0::DOUBLE * o / (len(a) + len(b)) ELSE 0 END), 4) AS rouge_1, sum(len(b))::BIGINT AS length, round(sum(len(b)) / count(*), 1) AS tokens_per_sample FROM o""")
def rouge_scores(spark, sf_dir):
    """Mean score of first answers against first prompts, in percent, and their lengths."""
    first = lambda role: text.words(F.get(F.filter("m", lambda x: x["role"] == role), F.lit(0))["content"])
    p = chat(spark, sf_dir).select(first("user").alias("a"), first("assistant").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return p.agg(F.count("*").alias("n"), F.round(F.avg(text.rouge(F.col("a"), F.col("b"))) * 100, 4).alias("rouge_1"), F.sum(F.size("b")).alias("length"), F.round(F.sum(F.size("b")) / F.count("*"), 1).alias("tokens_per_sample"))


@query("SELECT doc_id, strlen(coalesce(text, '')) AS n, true AS fits FROM documents")
def compression_sizes(spark, sf_dir):
    """Bytes of each text, and whether the least of three compressors' sizes is that of one of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), text.compressed_sizes(F.col("text")).alias("c"))
    return d.select("doc_id", "n", (F.col("c.least") == F.least("c.deflate", "c.bzip2", "c.lzma")).alias("fits"))


@query("SELECT p_partkey AS id, 'Solve: ' || trim(p_name) || chr(10) AS prompt, p_size::VARCHAR AS answer FROM part")
def task_rows(spark, sf_dir):
    """Rows of a task source: the rendered prompt, and the answer behind the mark."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.concat(F.lit("because\n#### "), F.col("p_size").cast("string")).alias("answer"))
    return p.select("id", text.fill_template("Solve: {question}\n", {"question": F.col("question")}).alias("prompt"), text.hash_answer(F.col("answer")).alias("answer"))
