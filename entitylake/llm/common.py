"""What the operators of this package share."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.session import scratch_dir

# Fixed value: what separates words (space, tab, line feed, vertical tab, form feed, carriage return).
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


#: Bytes of an Arrow batch, so that very long texts make no large one.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application. Spark itself serves the file to executors.

    Batches for Python are bounded by bytes from then on; results don't depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.sparkContext.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="package-")
        spark.sparkContext.addPyFile(
            shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        )
        _shipped.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text; a missing one is empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: the lineage ends here and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folders that a frame made of ``stored`` ones reads; nothing may read them any more."""
    spark = df.sparkSession
    for folder in sorted({file.rpartition("/")[0] for file in df.inputFiles()}):
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one computation, deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


def row_key(id_column: str, text_column: str) -> list[Column]:
    """The id and the digest of the text, by which a document is found again."""
    return [F.col(id_column).cast("long").alias("id"), F.xxhash64(whole_text(text_column)).alias("digest")]


def one_per_part(docs: DataFrame, made: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each part, with all columns. made: per row of docs its ``row_key`` and part.

    It is the row with the least id, a null id last; of several with that id, the one with the least digest of its
    text, and of several with that text too, the one that is least as JSON.
    """
    keys = made.groupBy("part", "id", "digest").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("id").isNull(), "id", "digest")
    first = keys.groupBy("part").agg(F.min(rank).alias("first"))
    judged = keys.join(first, "part").select("id", "digest", (rank == F.col("first")).alias("stays"), "n")
    rows = docs.select(F.struct("*").alias("row"), *row_key(id_column, text_column))

    def met(which: DataFrame, how: str) -> DataFrame:
        key = which.select(F.col("id").alias("key_id"), F.col("digest").alias("key_digest"))
        return rows.join(key, F.col("id").eqNullSafe(F.col("key_id")) & (F.col("digest") == F.col("key_digest")), how)

    alone = met(judged.filter("not stays or n > 1"), "left_anti").select("row.*")
    # Only rows that have the same id and text as another are grouped.
    again = met(judged.filter("stays and n > 1"), "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return alone.unionByName(again.select("row.*"))


def hash60(*columns: Column) -> Column:
    """A number of 60 bits that any SQL engine gives too: the first 15 hexadecimal digits of an MD5 sum."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def least(df: DataFrame, number: Column, rows: int) -> DataFrame:
    """About the ``rows`` rows with the least numbers of 60 bits, a sample by digest.

    Only rows below four times the share wanted are sorted, so tasks don't each hand ``rows`` rows to the driver.
    """
    share = min(1.0, 4 * rows / max(1, df.count()))
    low = df.withColumn("_number", number).filter(F.col("_number") < int(share * (1 << 60)))
    return low.orderBy("_number", *df.columns).limit(rows).drop("_number")
