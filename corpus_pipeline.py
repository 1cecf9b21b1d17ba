"""A corpus pipeline over documents: rules, near-duplicates, long repeats, source weights, packed sequences.

Every stage works on all rows that the one before kept and returns the columns of documents; the last returns the
pieces of documents with their place in a sequence. ``n_chars`` follows the text where a stage changes it. A
document that the mix takes several times is as many rows, and one that it doesn't take is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.llm import common, mixing, near_copies, packing, quality, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id: five words, similarity 0.8 or more."""
    return near_copies.keep_one(docs).select(*COLUMNS)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of repeated passages. A character cut in two goes entirely."""
    cut = suffix_dedup.dedup(docs, as_text=True)
    df = cut.select("rest.doc_id", F.col("kept").alias("text"), "rest.lang", "rest.source")
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*").select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, each at its place in a sequence."""
    return packing.place(packing.pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("suffix dedup", long_repeats),
    ("source weights", source_weights),
    ("packed sequences", packed_sequences),
]

#: SQL can express neither the learned rules nor tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next reads them."""
    docs = common.table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, common.stored(docs, name.replace(" ", "-")) if place else docs, sf_dir)
    return docs
