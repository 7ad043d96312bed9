"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, filter_audit, html_main, jaccard, mixing, packing, prefix_forest, quality, shards, suffix_dedup, token_counts, url_templates, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, words=51, apart=True)
    # Beyond the contract: the text, as documents have it, that stays when repeated passages of over 50 words go as well.
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"), F.length("kept_text").cast("long").alias("n_chars"), "n_passage_bytes")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), with_markup=False).select("page_id", "url", "text", "n_chars", "n_repeated")


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"))


def op6_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40).drop("text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, mixing.WEIGHTS).select("doc_id", "source", "copy", "order_key", "text")


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op11_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carried=["doc_id"])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_prefix_forest": op5_prefix_forest,
    "op6_kk_sharding": op6_kk_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_poisson_mixing": op8_poisson_mixing,
    "op9_url_templates": op9_url_templates,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_block_naming": op11_block_naming,
    "op12_filter_audit": op12_filter_audit,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE_SQL: dict[str, str] = {"op11_block_naming": block_naming.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op7_quality_rules": quality.ORACLE_SQL, "op8_poisson_mixing": mixing.ORACLE_SQL, "op9_url_templates": url_templates.ORACLE_SQL}
