"""Queries of the training-data operators over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import articles, chat, codebooks, interactions, ngram_join, packing, phrases, quality, repeats, tokens, training_order, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.groups(_table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, _table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.ordered_sequences(_table(spark, sf_dir, "documents"))


def op5_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digests(_table(spark, sf_dir, "conversations"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_digests(_table(spark, sf_dir, "documents"))


def op10_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op11_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.extract(_table(spark, sf_dir, "pages"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.coded(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_warc_packages, op3_url_filter, op4_training_order, op5_prefix_target_chat, op6_compression_bands, op7_best_fit_packing, op8_bpe, op9_suffix_dedup, op10_phrase_fingerprints, op11_tag_path_text, op12_filter_interactions, op13_cover_tree_codes)}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": ngram_join.GROUPS_SQL, "op2_warc_packages": warc.DIGEST_SQL, "op5_prefix_target_chat": chat.DIGEST_SQL, "op12_filter_interactions": interactions.AUDIT_SQL, "op13_cover_tree_codes": codebooks.CODED_SQL}
