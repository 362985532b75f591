"""Mixing sources to target weights by iterative proportional fitting (operator 3).

Documents fall into cells of source, language and topic. A partial aggregation gives the tokens of each cell. The cells' token
weights are raked: scaled to the target share of each source, then of each language, then of each topic, until all three
marginals hold, or come no nearer, which a warning tells. With w the raked tokens of a cell and t its own, a document is drawn with probability min(1, f * w / t), f such
that the expected tokens are `budget` of all; the draw compares it with a hash of the document's id, so that
it is the same in every run. Cells stay a DataFrame throughout; only marginal targets' totals reach the driver.

Targets default to smoothed shares: tokens ** power, normalised, per margin. Values without a target get none of the mixture;
targets for values that don't occur are ignored. Nulls in a margin are a value of their own. A null or empty text has one token's
weight. The topic is a column, or where there is none the text's form: its dominant non-prose trait. Repeated ids are drawn
together. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

MARGINS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
NONE = "-"  # stands for null inside, where every value has a sign in front


def text_form(text: Column) -> Column:
    """Topic stand-in: empty, tabular, numeric, emphatic or prose, by shares of characters."""
    n = F.length(text)
    share = lambda chars: (n - F.length(F.translate(text, chars, ""))) / n
    return (
        F.when(text.isNull() | (n == 0), "empty")
        .when(share("|") > 0.04, "tabular")
        .when(share("0123456789") > 0.1, "numeric")
        .when(share("!#$%&*") > 0.05, "emphatic")
        .otherwise("prose")
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6) -> DataFrame:
    """cells (source, lang, topic, tokens) with `w`, whose sums over each margin are the targets' shares of all tokens (as far
    as the margins agree with each other and cells exist). Goes on until the largest gap is under the tolerance, or four rounds
    make it less than 1 % smaller; then a warning tells the gap that remains."""
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for m in MARGINS:
        now = now.join(targets[m].select(m, F.col("share").alias(f"share_{m}")), m, "left").fillna(0.0, [f"share_{m}"])
    now = now.where(" AND ".join(f"share_{m} > 0" for m in MARGINS))
    before = float("inf")
    while True:
        for _ in range(4):
            for m in MARGINS:
                sums = F.sum("w").over(Window.partitionBy(m))
                now = now.withColumn("w", F.col("w") * F.col(f"share_{m}") / sums)
        now = staged(now, "cells")
        off = None
        for m in MARGINS:
            gap = now.groupBy(m).agg(F.sum("w").alias("w"), F.first(f"share_{m}").alias("s")).agg(F.max(F.abs(F.col("w") - F.col("s"))).alias("gap"))
            off = gap if off is None else off.union(gap)
        worst = off.agg(F.max("gap")).first()[0]
        if worst is None or worst < tolerance:
            break
        if worst > 0.99 * before:
            warnings.warn(f"raking ends with a gap of {worst:.3g} between a margin and its target", stacklevel=2)
            break
        before = worst
    return now.select(*MARGINS, "tokens", "w")


def mixture(docs: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, budget: float = 0.8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, tokens_col: str | None = None, seed: int = 17) -> DataFrame:
    """(id, source, lang, topic, n_tokens, probability, drawn) for every document. tokens_col has token counts; without it words
    between white space count."""
    spark, text = docs.sparkSession, F.col(text_col)
    named = lambda c: F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit(NONE))
    tokens = F.col(tokens_col) if tokens_col else F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))
    tokens = F.greatest(F.lit(1), F.coalesce(tokens, F.lit(1))).cast("long")
    topic = F.col(topic_col) if topic_col else text_form(text)
    rows = staged(docs.select(F.col(id_col).alias("id"), named(F.col(source_col)).alias("source"), named(F.col(lang_col)).alias("lang"), named(topic).alias("topic"), tokens.alias("n_tokens")), "rows")
    cells = staged(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    wanted = {}
    for m in MARGINS:
        if targets and m in targets:
            given = spark.createDataFrame([(NONE if k is None else f"+{k}", float(v)) for k, v in targets[m].items()], f"{m} string, share double")
            given = given.join(cells.select(m).distinct(), m, "left_semi")
        else:
            given = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(POWERS[m])).alias("share"))
        total = given.agg(F.sum("share")).first()[0] or 1.0
        wanted[m] = given.withColumn("share", F.col("share") / total)
    raked = rake(cells, wanted)
    all_tokens = cells.agg(F.sum("tokens")).first()[0] or 0
    # f by fixed-point steps: cells that reach probability 1 give what they can, the others share the rest
    goal, f = budget * all_tokens, budget * all_tokens
    while True:  # each step but the last brings a further cell to probability 1
        ratio = F.lit(f) * F.col("w") / F.col("tokens")
        full, open_ = raked.agg(F.sum(F.when(ratio >= 1, F.col("tokens")).otherwise(0)), F.sum(F.when(ratio < 1, F.col("w")).otherwise(0.0))).first()
        if not open_:
            break
        nxt = max(f, (goal - full) / open_)
        if nxt <= f * (1 + 1e-9):
            break
        f = nxt
    chance = raked.select(*MARGINS, F.least(F.lit(1.0), F.lit(f) * F.col("w") / F.col("tokens")).alias("probability"))
    out = rows.join(chance, list(MARGINS), "left").fillna(0.0, ["probability"])
    u = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    value = lambda m: F.when(F.col(m) != NONE, F.substring(m, 2, 1 << 30)).alias(m)
    return out.select(F.col("id").alias(id_col), *map(value, MARGINS), "n_tokens", "probability", (u < F.col("probability")).alias("drawn"))
