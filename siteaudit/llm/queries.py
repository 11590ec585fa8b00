"""The operators' queries: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.llm import bench_join, bwt_dedup, byte_bpe, extraction, langid, packing, prefix_trie, resampling, sharding, simhash, url_filter, vector_search, whitening
from siteaudit.llm.common import table


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op4_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_join.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids", "text_hash")


def op5_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("row")


def op6_merged_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.removal(table(spark, sf_dir, "documents"))


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector_search.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages"))


def op11_louds_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op12_column_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_crf_language, op2_bounded_ring, op3_digest_array, op4_prefix_join, op5_sum_of_squares, op6_merged_bwt, op7_additive_quantisation, op8_simhash_bktree, op9_importance_resampling, op10_block_rules,
        op11_louds_trie, op12_column_whitening, op13_byte_bpe,
    )
}
