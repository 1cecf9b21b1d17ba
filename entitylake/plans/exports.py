"""Export jobs: one table per entity in either layout, failures kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from entitylake.functions import variants as V
from entitylake.operators.chunks import with_chunks, with_row_numbers
from entitylake.operators.delivery import placeholder
from entitylake.operators.fields import custom_columns
from entitylake.operators.filters import updated_range
from entitylake.operators.layouts import sheet_rows, workbook_table
from entitylake.specs import ENTITIES, canonical_name

REPORT_SCHEMA = "entity string, status string, rows bigint, error string"
ORDER, PLACE = "_order", "_place_in_order"
# The lines of a summary without entities.
SUMMARY = ("No data available to export", "Please export data first")


def _observed_write(df: DataFrame, path: str, fmt: str) -> int:
    """Write and count in the same pass."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)
    return seen.get["n"]


def _per_entity(
    spark: SparkSession, frames: dict[str, DataFrame], export: Callable[[str, DataFrame], tuple[str, int]]
) -> list[tuple[str, str, int, str | None]]:
    report = []
    for entity, df in frames.items():
        try:
            status, rows = export(entity, df)
            report.append((entity, status, rows, None))
        except Exception as error:
            report.append((entity, "failed", 0, str(error)))
    return report


def export_workbook(
    spark: SparkSession,
    frames: dict[str, DataFrame],
    out: str,
    date_from: str | None = None,
    date_to: str | None = None,
    fmt: str = "parquet",
    typed: bool = False,
) -> DataFrame:
    """One workbook table per entity below ``out``; returns the report.

    An entity without rows gets a one-row placeholder, a failing one an
    ``<entity>_error`` table; with no entity at all there is a ``Summary``.
    """

    def export(entity: str, df: DataFrame) -> tuple[str, int]:
        chosen = updated_range(df, date_from, date_to)
        if chosen.isEmpty():
            _write_rows(spark, "Info string", [(placeholder(entity),)], f"{out}/{entity}", fmt)
            return "empty", 0
        table = workbook_table(chosen, custom_columns(chosen), typed)
        return "written", _observed_write(table, f"{out}/{entity}", fmt)

    report = _per_entity(spark, frames, export)
    for entity, status, _, error in report:
        if status == "failed":
            _write_rows(spark, "Error string", [(f"Error processing {entity}: {error}",)], f"{out}/{entity}_error", fmt)
    if not report:
        _write_rows(spark, "Message string", [(line,) for line in SUMMARY], f"{out}/Summary", fmt)
    return spark.createDataFrame(report, REPORT_SCHEMA)


def _write_rows(spark: SparkSession, schema: str, rows: list[tuple], path: str, fmt: str) -> None:
    _observed_write(spark.createDataFrame(rows, schema).coalesce(1), path, fmt)


def export_sheets(
    spark: SparkSession,
    frames: dict[str, DataFrame],
    out: str,
    targets: dict[str, str],
    date_from: str | None = None,
    date_to: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Header and numbered, chunked cell rows per entity below ``out``; returns the report.

    Aliases go by their entity's name. Empty entities are skipped; an entity without a target fails alone.
    """
    given = {canonical_name(name) for name, target in targets.items() if target}

    def export(entity: str, df: DataFrame) -> tuple[str, int]:
        if entity not in given:
            raise LookupError(f"no delivery target for {entity}")
        chosen = updated_range(df, date_from, date_to)
        if chosen.isEmpty():
            return "empty", 0
        key = ENTITIES[entity].key if entity in ENTITIES else "id"
        ordered = chosen.withColumn(ORDER, row_order(chosen, key))
        if not _kept_by_parquet(ordered):
            headers, rows = sheet_rows(ordered, custom_columns(chosen), around=(ORDER,))
            numbered = with_row_numbers(rows, ORDER).drop(ORDER)
        else:
            # Documents are numbered before their cells are made: dealing rows to ranges computes them twice.
            documents = with_row_numbers(ordered, ORDER).drop(ORDER).withColumnRenamed("rn", PLACE)
            headers, numbered = sheet_rows(documents, custom_columns(documents), around=(PLACE,))
            numbered = numbered.withColumnRenamed(PLACE, "rn")
        _write_rows(spark, "headers array<string>", [(headers,)], f"{out}/{entity}/header", "json")
        placed = with_chunks(numbered.select(*[c for c in numbered.columns if c != "rn"], "rn"))
        return "written", _observed_write(placed, f"{out}/{entity}/rows", fmt)

    named = {canonical_name(name): df for name, df in frames.items()}
    return spark.createDataFrame(_per_entity(spark, named, export), REPORT_SCHEMA)


def _kept_by_parquet(df: DataFrame) -> bool:
    """Whether its rows can be written as they are; columns of no type and intervals can't."""
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    return "rn" not in df.columns and not any("void" in kind or "interval" in kind for kind in kinds)


def row_order(df: DataFrame, key: str) -> Column:
    """Order of a delivered table: the numeric id, else a hash of the row.

    The hash needs whole rows, so it is left out where every row has an id.
    """
    number = V.named(key).cast("string").try_cast("bigint")
    if df.filter(number.isNull()).isEmpty():
        return number
    text = F.to_json(F.struct(*[V.named(c) for c in sorted(df.columns)]))
    return F.coalesce(number, F.xxhash64(text))
