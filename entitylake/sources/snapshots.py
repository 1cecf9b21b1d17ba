"""A snapshot of a history, kept up by folding new changes into the buckets they touch.

The snapshot has one row per id, in folders by a hash of the id. Folding groups the rows of touched buckets only and
writes those anew. Reading takes the snapshot as it is: its rows meet the ids of newer changes in a semi and an anti
join, and only what they share is grouped. While the ids of newer changes are few, adaptive execution broadcasts them by
their measured size, and no row of the snapshot is shuffled.

The history stays complete, so a snapshot can always be made again. ``folds`` names what the snapshot holds: a row
before its buckets are written says that it can't be read, a row after it says up to which arrival it holds all
changes. A fold that stopped in between leaves the first; reads go to the history until the next fold, which begins anew.
Buckets are replaced in place: a read that runs during a fold may miss a file, fail, and has to be repeated.

Changes are newer if they arrived after that time less ``overlap``, which must be longer than the longest batch:
a batch carries the time of its start and may be committed after a later one. A change that is folded twice changes nothing.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.functions import variants as V
from entitylake.operators import upsert as U
from entitylake.session import scratch_dir
from entitylake.sources.history import ARRIVED, History, exists

BUCKET = "_bucket"
FOLD_SCHEMA = "place bigint, generation string, upto timestamp"


class Snapshot:
    def __init__(self, history: History, buckets: int = 256, overlap: timedelta = timedelta(days=1)) -> None:
        self.history, self.buckets, self.overlap = history, buckets, overlap
        self.spark, self.keys = history.spark, [history.key, U.CONTENT_KEY]
        self.rows_path, self.folds_path = f"{history.path}/snapshot", f"{history.path}/folds"

    def fold(self) -> int:
        """Bring the snapshot up to all that has arrived; gives the number of buckets written."""
        generation, upto, place = self.history.generation(), self._upto(), self._folds().count()
        newest = self.history.changes().agg(F.max(ARRIVED).alias("at")).first()["at"]
        if newest is None or newest == upto:
            return 0
        changed = self._stored(self._bucketed(self._newer(upto)), "fold-changes")
        touched = [r[BUCKET] for r in changed.select(BUCKET).distinct().collect()]  # at most ``buckets``
        merged = changed
        if upto is not None:
            merged = changed.unionByName(self._rows(F.col(BUCKET).isin(touched)), allowMissingColumns=True)
        merged = self._stored(U.latest_by_id(merged, self.keys, self._order()), "fold-rows").drop(U.CONTENT_KEY)
        self._mark(place, generation, None)
        writer = merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET)
        # Without a snapshot that can be read, whatever an unfinished fold has left goes.
        writer.option("partitionOverwriteMode", "static" if upto is None else "dynamic").parquet(self.rows_path)
        self._mark(place + 1, generation, newest)
        return len(touched)

    def current(self) -> DataFrame:
        """The same rows as ``History.current``."""
        upto = self._upto()
        if upto is None:
            return self.history.current()
        newer, columns = self._newer(upto)
        rows = self._rows()
        newer = U.latest_by_id(newer, self.keys, self._order())
        ids = newer.select(*[V.named(k).alias(f"_of{i}") for i, k in enumerate(self.keys)])
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same = same & V.named(k).eqNullSafe(F.col(f"_of{i}"))
        met = rows.join(ids, same, "left_semi").drop(BUCKET)
        latest = U.latest_by_id(newer.unionByName(met, allowMissingColumns=True), self.keys, self._order())
        untouched = rows.join(ids, same, "left_anti").drop(BUCKET)
        return latest.unionByName(untouched, allowMissingColumns=True).select(*[V.named(c) for c in columns])

    def _order(self) -> list[str]:
        return [*self.history.order_by, ARRIVED]

    def _newer(self, upto) -> tuple[DataFrame, list[str]]:
        """Rows that may not be in the snapshot, without deleted ones, and the table's columns."""
        changes = self.history.changes()
        if upto is not None:
            changes = changes.filter(F.col(ARRIVED) >= F.lit(upto - self.overlap))
        return self.history.alive(changes)

    def _rows(self, which=None) -> DataFrame:
        """Rows of the snapshot, without deleted ones, with what tells rows without an id apart."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.rows_path)
        rows = rows if which is None else rows.filter(which)
        return self.history.without_deleted(self.history.with_content(rows, [c for c in rows.columns if c not in (ARRIVED, BUCKET)]))

    def _bucketed(self, alive: tuple[DataFrame, list[str]]) -> DataFrame:
        rows, _ = alive
        # The text of an id, so that its bucket doesn't depend on the type it was read with.
        number = F.xxhash64(V.named(self.history.key).cast("string"), U.CONTENT_KEY)
        return rows.withColumn(BUCKET, F.pmod(number, F.lit(self.buckets)).cast("int"))

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _folds(self) -> DataFrame:
        if exists(self.spark, self.folds_path):
            return self.spark.read.schema(FOLD_SCHEMA).parquet(self.folds_path)
        return self.spark.createDataFrame([], FOLD_SCHEMA)

    def _upto(self):
        """The arrival up to which the snapshot of the generation that is read holds all; none if it can't be read."""
        last = self._folds().agg(F.max_by(F.struct("generation", "upto"), "place").alias("last")).first()["last"]
        return last["upto"] if last is not None and last["generation"] == self.history.generation() else None

    def _mark(self, place: int, generation: str | None, upto) -> None:
        self.spark.createDataFrame([(place, generation, upto)], FOLD_SCHEMA).write.mode("append").parquet(self.folds_path)
