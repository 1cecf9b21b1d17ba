"""Loads that start where the newest update seen so far ends.

The mark of an entity is the greatest ``updated_at`` that its loads have stored, kept as append-only rows and written
after the data: a stop between the two loads the same rows again, which changes nothing. A load reads the source
from the mark minus an overlap on, so changes to documents of early pages are seen and pages need no numbers. The
mark is observed while the rows are written, so the source is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from entitylake.functions import variants as V
from entitylake.sources.history import History, exists
from entitylake.specs import canonical_name

MARK_SCHEMA = "entity string, mark bigint, n bigint, marked_at timestamp"


class HighWater:
    """The marks of all entities, below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def marks(self) -> DataFrame:
        """(entity, mark, loads, last_load): one row per entity that has a mark."""
        seen = self.spark.read.schema(MARK_SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], MARK_SCHEMA)
        return seen.groupBy("entity").agg(F.max("mark").alias("mark"), F.count("*").alias("loads"), F.max("marked_at").alias("last_load"))

    def of(self, entity: str) -> int | None:
        row = self.marks().filter(F.col("entity") == canonical_name(entity)).first()
        return row["mark"] if row else None

    def record(self, entity: str, mark: int | None, n: int) -> None:
        """A mark is kept once there is one; a load that brought nothing moves none."""
        row = self.spark.createDataFrame([(canonical_name(entity), mark, n)], "entity string, mark bigint, n bigint")
        row.withColumn("marked_at", F.current_timestamp()).write.mode("append").parquet(self.path)


def load_changed(source: DataFrame, table: History, marks: HighWater, entity: str, overlap: int = 0, column: str = "updated_at") -> int:
    """Append the source's rows that were updated at or after the mark minus ``overlap`` seconds; gives their number.

    Without a mark all rows are loaded, also those without a time, which no later load brings again.
    """
    mark = marks.of(entity)
    rows = source if mark is None else source.filter(V.named(column) >= F.lit(mark - overlap))
    seen = Observation()
    table.append(rows.observe(seen, F.max(V.named(column).cast("bigint")).alias("mark"), F.count(F.lit(1)).alias("n")))
    found = seen.get
    marks.record(entity, found["mark"], found["n"])
    return found["n"]
