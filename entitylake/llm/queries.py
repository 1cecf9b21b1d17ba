"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.llm import (
    common, mixing, negatives, packing, prefix_join, quality, sharding, simhash, spellings, suffix_dedup, token_counts, token_output, top_k,
    url_filters,
)

#: Host, path and verdict of each rule.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(common.table(spark, sf_dir, "documents"))
    return found.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filters.judge(common.table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = token_output.read_files(token_output.write_files(common.table(spark, sf_dir, "documents")))
    return documents.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(common.table(spark, sf_dir, "documents"))
    crc = F.crc32("ids").alias("ids_crc32")
    return packing.place(pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", crc, "part", "place"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("row.doc_id", "size", "source_size", "target", taken)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(common.table(spark, sf_dir, "documents"))
    return sharded.select("row.doc_id", "n_bytes", "shard", "depth", "shard_bytes", "oversized")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.components_of(common.table(spark, sf_dir, "documents"))


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.group_spellings(common.table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The contract's own noise: every seventh label moves on by one.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_token_output": op3_token_output,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_top_k": op9_top_k,
    "op10_sharding": op10_sharding,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_spellings": op12_spellings,
    "op13_hard_negatives": op13_hard_negatives,
}
