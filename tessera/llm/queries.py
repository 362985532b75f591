"""The queries of this subpackage's operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .id_files import id_files
from .language_id import identify_language
from .mixture import mixture
from .ngram_join import ngram_join
from .sharding import shard
from .substring_dedup import repeated_passages
from .tokens import bpe_digests, token_counts
from .vectors import exact_top_k, near_neighbours


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_mixture_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each passage to remove: the document that loses it and the one that keeps it."""
    out = repeated_passages(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("keeper").alias("keeper_doc_id"), F.col("start").alias("start_word"), F.col("n").alias("n_words"), F.col("keeper_start").alias("keeper_start_word"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, threshold="0.9")


def op8_near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without an id isn't held out, nor learnt from."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    out = identify_language(table(spark, sf_dir, "documents"), learn=fold != 2)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_vector_bin_packing, op2_bpe_encode_decode, op3_mixture_weights, op4_substring_dedup, op5_token_counts, op6_exact_top_k, op7_ngram_jaccard_join, op8_near_neighbours, op9_language_id, op10_id_files, pipeline)}

#: SQL where it can state the result on whole tables (the driver's other queries of this list are held against brute force).
ORACLE_SQL = {
    "op6_exact_top_k": """
        WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, cast(list_inner_product(cast(q.v AS DOUBLE[]), cast(c.v AS DOUBLE[])) AS BIGINT) AS score
                   FROM c AS q JOIN c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
