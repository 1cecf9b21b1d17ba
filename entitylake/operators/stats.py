"""Counts and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.functions.custom_fields import has_values
from entitylake.operators.fields import fields_long
from entitylake.operators.layouts import base_columns
from entitylake.operators.progress import entity_names
from entitylake.specs import CUSTOM_FIELDS, LINK_URL, LINKS, canonical


def entity_counts(frames: dict[str, DataFrame], with_logs: bool = False) -> DataFrame:
    """(entity, n) per fixed entity, zero included; aliases count together."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in frames.items()]
    counts = reduce(DataFrame.unionByName, counted)
    per_entity = counts.groupBy(canonical(F.col("entity")).alias("entity")).agg(F.sum("n").alias("n"))
    names = entity_names(counts)
    if with_logs:
        names = names.union(names.limit(1).select(F.lit("logs")))
    return names.join(per_entity, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n"))


def field_profile(df: DataFrame, entity: str) -> DataFrame:
    """(entity, columns, custom_columns, fields): what a workbook of the frame would hold."""
    base = base_columns(df)
    fixed = len(base) + (LINKS in df.columns and LINK_URL not in base)
    if CUSTOM_FIELDS not in df.columns:
        df = df.withColumn(CUSTOM_FIELDS, F.lit(None).cast("string"))
    long = fields_long(df, ["id"]).filter(has_values(F.col("field_values")))
    distinct = long.groupBy("field_id", "field_name").agg(F.count("*").alias("n"))
    return distinct.agg(F.count("*").alias("custom_columns"), F.coalesce(F.sum("n"), F.lit(0)).alias("fields")).select(
        F.lit(entity).alias("entity"),
        (F.lit(fixed) + F.col("custom_columns")).cast("bigint").alias("columns"),
        "custom_columns",
        "fields",
    )


def webhook_counts(webhooks: DataFrame) -> DataFrame:
    """(event_type, n) per type and, with event_type NULL and is_total, over all."""
    by_type = webhooks.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("is_total", F.lit(False))
    total = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit(None).cast("string").alias("event_type"), "n", F.lit(True).alias("is_total")
    )
    return by_type.unionByName(total)
