"""What goes around a delivered table: targets, placeholders, the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.operators.progress import entity_names
from entitylake.specs import ENTITIES, canonical


def target_frame(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """(entity, target) of configured targets, which are a handful."""
    spark = df.sparkSession
    rows = [(name, target) for name, target in targets.items() if target]
    given = spark.createDataFrame(rows, "entity string, target string")
    return given.select(canonical(F.col("entity")).alias("entity"), "target")


def with_target(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Add the delivery target of each row's entity; an entity without one has NULL."""
    lookup = F.broadcast(target_frame(df, targets))
    return df.withColumn("entity", canonical(F.col("entity"))).join(lookup, "entity", "left")


def missing_targets(targets: dict[str, str]) -> list[str]:
    given = {name for name, target in targets.items() if target}
    return [s.name for s in ENTITIES.values() if not given & {s.name, *s.aliases}]


def placeholder(entity: str) -> str:
    # Fixed value: the text of an entity without rows.
    return f"No {entity} data available"


def empty_placeholders(frames: dict[str, DataFrame]) -> DataFrame:
    """(entity, Info) for each fixed entity without a row.

    Reads one row per entity at most, whatever its size.
    """
    first_rows = [df.limit(1).select(canonical(F.lit(name)).alias("entity")) for name, df in frames.items()]
    present = reduce(DataFrame.union, first_rows)
    missing = entity_names(present).join(present, "entity", "left_anti")
    return missing.select(
        "entity", F.concat(F.lit("No "), F.col("entity"), F.lit(" data available")).alias("Info")
    )
