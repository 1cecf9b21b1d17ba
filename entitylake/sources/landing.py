"""Landed pages and webhook bodies as DataFrames, batch or streaming.

A landing folder holds JSON text, one envelope or event per line (or per file
with ``whole_files``). Text that is no JSON never fails a job: it stays in
``raw`` with a NULL value, ready for a quarantine table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import variants as V
from entitylake.specs import canonical_name

PAGE_IN_PATH = r"page=(\d+)"


def _page_columns(text: DataFrame, entity: str) -> DataFrame:
    envelope = V.strict_json(F.col("value"))
    in_path = F.regexp_extract(F.col("_metadata.file_path"), PAGE_IN_PATH, 1)
    return text.select(
        F.lit(canonical_name(entity)).alias("entity"),
        F.col("_metadata.file_path").alias("source"),
        F.when(in_path != "", in_path.cast("bigint")).alias("path_page"),
        F.col("value").alias("raw"),
        envelope.alias("envelope"),
    ).select(
        "entity",
        "source",
        F.coalesce(V.at(F.col("envelope"), "$._page", "bigint"), F.col("path_page")).alias("page"),
        "raw",
        "envelope",
    )


def read_pages(spark: SparkSession, path: str, entity: str, whole_files: bool = False) -> DataFrame:
    """(entity, source, page, raw, envelope) of every landed page below ``path``."""
    reader = spark.read.option("recursiveFileLookup", "true").option("wholetext", str(whole_files).lower())
    return _page_columns(reader.text(path), entity)


def stream_pages(
    spark: SparkSession, path: str, entity: str, pages_per_batch: int = 10, whole_files: bool = False
) -> DataFrame:
    """The same as a stream taking ``pages_per_batch`` files at a time."""
    reader = (
        spark.readStream.schema("value string")
        .option("recursiveFileLookup", "true")
        .option("wholetext", str(whole_files).lower())
        .option("maxFilesPerTrigger", pages_per_batch)
    )
    return _page_columns(reader.text(path), entity)


def quarantined(pages: DataFrame, value: str = "envelope") -> DataFrame:
    """Landed text that is not JSON."""
    return pages.filter(F.col(value).isNull() & F.col("raw").isNotNull())


def typed_documents(documents: DataFrame, fields: dict[str, str], doc: str = "doc") -> DataFrame:
    """Promote known keys of ``doc`` to typed columns, keeping the document.

    ``fields`` maps a key to a Spark type. Hot keys become real columns here so
    that later scans prune and push down on them.
    """
    promoted = [_promoted(V.named(doc), key, kind).alias(key) for key, kind in fields.items()]
    return documents.select(*promoted, *[V.named(c) for c in documents.columns if c not in fields])


def _promoted(doc: Column, key: str, kind: str) -> Column:
    return V.at(doc, f"$['{key}']", kind)


# -- webhooks ------------------------------------------------------------------

WEBHOOK_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def _webhook_columns(text: DataFrame, received_at: Column) -> DataFrame:
    body = V.strict_json(F.col("value"))
    return text.select(F.col("value").alias("raw"), body.alias("body"), received_at.alias("_received_at")).select(
        V.at(F.col("body"), "$.event_type", "string").alias("event_type"), "body", "raw", "_received_at"
    )


def read_webhooks(spark: SparkSession, path: str) -> DataFrame:
    """All landed events; the time of receipt is that of the file."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    return _webhook_columns(text, F.col("_metadata.file_modification_time"))


def stream_webhooks(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events as they land; the file time is kept, so a replay gives the same rows."""
    text = (
        spark.readStream.schema(WEBHOOK_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(path)
    )
    return _webhook_columns(text, F.col("_metadata.file_modification_time"))
