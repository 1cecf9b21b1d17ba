"""Dense row numbers and chunk placement of a delivered table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylake.functions import variants as V
from entitylake.session import scratch_dir

CHUNK_ROWS = 5_000  # Fixed value: data rows per written range.
ROWS_PER_SLICE = 100_000
LOCAL_BITS = 33  # Fixed value: bits of monotonically_increasing_id that number a partition's rows.


def with_row_numbers(df: DataFrame, order_by: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``rn``: 0, 1, 2 … in ascending order of a unique BIGINT column.

    Rows are dealt to ranges of the order, sorted there and written to the shared folder with their number in
    the range; a range starts where the counts of those before it end. The written ranges are read from then on,
    so a lost executor changes no number. The number of ranges follows the number of rows.
    """
    spark = df.sparkSession
    key = V.named(order_by)
    slices = max(df.select(key).count() // rows_per_slice + 1, spark.sparkContext.defaultParallelism)
    ordered = df.repartitionByRange(slices, key).sortWithinPartitions(key)
    placed = ordered.withColumn("_place", F.monotonically_increasing_id())
    path = scratch_dir(spark, "numbered")
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    stored = stored.withColumn("_slice", F.shiftright("_place", LOCAL_BITS))
    counts = stored.groupBy("_slice").agg(F.count("*").alias("n"))  # one row per range
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_slice").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    numbered = stored.join(starts, F.col("_slice") == F.col("_s"))
    local = F.col("_place") - F.shiftleft("_slice", LOCAL_BITS)
    return numbered.withColumn("rn", F.col("_start") + local).select(*[V.named(c) for c in df.columns], "rn")


def with_chunks(numbered: DataFrame, sheet: str = "Data", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the chunk of a numbered row and the cell range the chunk starts at.

    The header takes row 1, so chunk ``i`` starts at row ``i * chunk_rows + 2``.
    """
    chunk = F.expr(f"rn div {chunk_rows}")
    first_row = (chunk * chunk_rows + 2).cast("string")
    return numbered.withColumn("chunk", chunk).withColumn("range", F.concat(F.lit(f"{sheet}!A"), first_row))


def chunk_plan(rows: int, sheet: str = "Data", chunk_rows: int = CHUNK_ROWS) -> list[tuple[int, str, int]]:
    """(chunk, range, rows) of a table of known length."""
    return [
        (number, f"{sheet}!A{start + 2}", min(chunk_rows, rows - start))
        for number, start in enumerate(range(0, rows, chunk_rows))
    ]
