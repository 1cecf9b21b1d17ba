"""A keyed table as the history of its changes, in plain parquet folders.

Loads append change rows with Spark's own parquet streaming sink, one folder per load; batch jobs append to a
folder of their own, deletions to another. Nothing is ever rewritten by a load: a batch costs what it brings. The
current state is the latest row of each id, so rows that a repeated batch or another load brings again change
nothing. Compaction is a job of its own: into a new folder (``compact``), or step by step beside the history
(``snapshots``).

A replacement is a new generation: its rows are appended under a name of their own, and a row in ``generations``,
written after them, makes it the one that is read. Rows of a replacement that stopped before that are never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from entitylake.functions import variants as V
from entitylake.operators import upsert as U

ARRIVED, GENERATION = "_arrived", "_generation"
ROWS_PER_TASK = 500_000  # Rows of a task that merges, unless ids have more changes.
LOADS, DELETIONS, GENERATIONS = "changes", "deletions", "generations"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


class History:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", order_by: Sequence[str] = ()) -> None:
        """The greatest row of an id by ``order_by`` is its current one; among equals, or without an order, the last to arrive."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.key = key
        self.order_by = list(order_by)

    # -- writing ---------------------------------------------------------------

    def stream(self, changes: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
        """Append all available rows of a stream, then end. A checkpoint has its own folder here."""
        folder = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        return (
            self._stamped(changes, self.generation())
            .writeStream.format("parquet")
            .option("path", f"{self.path}/{LOADS}/load-{folder}")
            .option("checkpointLocation", checkpoint)
            .queryName(name)
            .trigger(availableNow=True)
            .start()
        )

    def append(self, changes: DataFrame) -> None:
        self._write(changes, self.generation())

    def replace(self, rows: DataFrame) -> bool:
        """The rows as the whole table; an empty delivery leaves it as it is. Gives whether it was replaced."""
        if rows.isEmpty():
            return False
        place, name = self._marks().count(), uuid.uuid4().hex
        self._write(rows, name)
        mark = self.spark.createDataFrame([(place, name)], "place bigint, name string")
        mark.write.mode("append").parquet(f"{self.path}/{GENERATIONS}")
        return True

    def _stamped(self, changes: DataFrame, generation: str | None) -> DataFrame:
        return changes.withColumns({ARRIVED: F.current_timestamp(), GENERATION: F.lit(generation).cast("string")})

    def _write(self, changes: DataFrame, generation: str | None) -> None:
        self._stamped(changes, generation).write.mode("append").parquet(f"{self.path}/{LOADS}/batch")

    def _marks(self) -> DataFrame:
        if exists(self.spark, f"{self.path}/{GENERATIONS}"):
            return self.spark.read.schema("place bigint, name string").parquet(f"{self.path}/{GENERATIONS}")
        return self.spark.createDataFrame([], "place bigint, name string")

    def generation(self) -> str | None:
        """The name of the last replacement; none where the table was never replaced."""
        return self._marks().agg(F.max_by("name", F.struct("place", "name")).alias("name")).first()["name"]

    def delete(self, ids: DataFrame) -> None:
        """Remove what has arrived of the given ids; ids of any type are compared as text, unknown ones are no error."""
        gone = ids.select(V.named(self.key).cast("string").alias("gone_id")).filter("gone_id is not null").distinct()
        gone.withColumn("gone_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/{DELETIONS}")

    def compact(self, path: str) -> History:
        """The current rows as a history in another folder."""
        to = History(self.spark, path, self.key, self.order_by)
        to.append(self.current())
        return to

    # -- reading ---------------------------------------------------------------

    def changes(self) -> DataFrame:
        """Every row that has arrived."""
        if not exists(self.spark, f"{self.path}/{LOADS}"):
            raise LookupError(f"no table at {self.path}")
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{LOADS}/*")

    def current(self) -> DataFrame:
        """One row per id; rows without an id are told apart by their content."""
        rows, columns = self.alive(self.changes())
        latest = U.latest_by_id(rows, [self.key, U.CONTENT_KEY], [*self.order_by, ARRIVED])
        return latest.select(*[V.named(c) for c in columns])

    def merged(self) -> DataFrame:
        """One row per id, each field from the last row that carries it (is not NULL); rows without an id as in ``current``."""
        rows, columns = self.alive(self.changes())
        keys = [self.key, U.CONTENT_KEY]
        # Sorts, before and after the shuffle, would else hold as many rows as a split of the files or a fixed share of the table.
        tasks = max(self.changes().count() // ROWS_PER_TASK + 1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(tasks, *[V.named(c) for c in keys])
        tie = F.xxhash64(*[V.named(c) for c in sorted(columns)])
        order = F.struct(*[V.named(c) for c in (*self.order_by, ARRIVED)], tie)
        last = [F.max_by(V.named(c), F.when(V.named(c).isNotNull(), order)).alias(c) for c in columns if c != self.key]
        return rows.groupBy(*[V.named(c) for c in keys]).agg(*last).select(*[V.named(c) for c in columns])

    def alive(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """Those of the given changes that are of the generation that is read and not deleted, and the table's own columns."""
        columns = [c for c in rows.columns if c not in (ARRIVED, GENERATION)]
        if GENERATION in rows.columns:
            rows = rows.filter(F.col(GENERATION).eqNullSafe(F.lit(self.generation()))).drop(GENERATION)
        return self.without_deleted(self.with_content(rows, columns)), columns

    def with_content(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Add what tells rows without an id apart, a digest of the table's own columns."""
        content = F.to_json(F.struct(*[V.named(c) for c in sorted(columns)]))
        return rows.withColumn(U.CONTENT_KEY, F.when(V.named(self.key).isNull(), F.sha2(content, 256)))

    def without_deleted(self, rows: DataFrame) -> DataFrame:
        """Rows that no deletion has removed after they arrived."""
        if not exists(self.spark, f"{self.path}/{DELETIONS}"):
            return rows
        gone = self.spark.read.parquet(f"{self.path}/{DELETIONS}").groupBy("gone_id").agg(F.max("gone_at").alias("gone_at"))
        rows = rows.join(gone, V.named(self.key).cast("string") == F.col("gone_id"), "left")
        return rows.filter(F.col("gone_at").isNull() | (F.col(ARRIVED) > F.col("gone_at"))).drop("gone_id", "gone_at")


def merge_into_catalog(changes: DataFrame, table: str, key: str = "id", order_by: Sequence[str] = ("updated_at",)) -> None:
    """K1 as MERGE, for catalogs whose tables support it; ids must be given."""
    source = U.latest_by_id(changes, key, order_by)
    (
        source.alias("s")
        .mergeInto(table, F.expr(f"{table}.{key} = s.{key}"))
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )
