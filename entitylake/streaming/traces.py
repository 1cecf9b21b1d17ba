"""Progress of loads while they run: one event per committed batch, from the metrics that the query observes.

A load counts its documents and pages while it writes them, so an event costs no further pass over the data. Spark
reports the metrics of a batch after its commit. An event is stored below the id of its query and the number of its
batch; both outlive a restart, so a batch that is repeated replaces its event and doubles none.

If the driver is lost between a commit and its event, that event is missing. Pages only grow, so the next event makes
the state right again; ``loads.record_load`` reads the traces from the stored rows where each page must have one.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from entitylake.operators.pages import PAGE_SIZE
from entitylake.operators.progress import PROGRESS_SCHEMA
from entitylake.specs import canonical_name

METRICS, LOAD = "load", "load-"
EVENT_SCHEMA = f"{PROGRESS_SCHEMA}, documents bigint"


def measured(documents: DataFrame) -> DataFrame:
    """The same documents of pages, observed: how many, the last page, and how many are on it."""
    place = F.struct("page", "pos")
    return documents.observe(
        METRICS,
        F.count(F.lit(1)).alias("documents"),
        F.max("page").cast("bigint").alias("page"),
        (F.max_by("pos", place) + 1).cast("bigint").alias("on_page"),
    )


class LoadTraces(StreamingQueryListener):
    """Writes an event per batch with documents of every query named ``load-<entity>``."""

    def __init__(self, spark: SparkSession, path: str, page_size: int = PAGE_SIZE) -> None:
        self.spark, self.path, self.page_size = spark, path.rstrip("/"), page_size
        self.errors: list[Exception] = []
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        seen = told.observedMetrics.get(METRICS)
        if seen is None or not seen["documents"] or not (told.name or "").startswith(LOAD):
            return
        try:
            self._write(told, seen)
        except Exception as error:  # Spark only logs it; ``wait`` raises it
            self.errors.append(error)

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def _write(self, told, seen) -> None:
        row = (canonical_name(told.name.removeprefix(LOAD)), seen["page"], seen["on_page"] < self.page_size, told.timestamp, told.batchId, seen["documents"])
        made = self.spark.createDataFrame([row], "entity string, page bigint, completed boolean, ts string, seq bigint, documents bigint")
        event = made.select(
            "entity", F.lit("progress").alias("kind"), F.col("page").cast("int"), "completed", F.col("ts").cast("timestamp"), "seq", "documents"
        )
        event.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={told.id}/batch={told.batchId}")

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the query has ended and its last event is stored."""
        query.awaitTermination()
        if not self._ended[str(query.runId)].wait(seconds):
            raise TimeoutError(f"no end of {query.name} was reported within {seconds} s")
        if self.errors:
            raise self.errors[0]


@contextmanager
def traced(spark: SparkSession, path: str, page_size: int = PAGE_SIZE) -> Iterator[LoadTraces]:
    """Loads that run meanwhile leave their events below ``path``."""
    listener = LoadTraces(spark, path, page_size)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """The stored events, in the form of ``progress`` and with the number of documents."""
    columns = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{path.rstrip('/')}/*/*").select(*columns)


def log_entries(events: DataFrame) -> DataFrame:
    """A log entry per event, in the form of ``oplog``."""
    message = F.concat(F.lit("Loaded "), F.col("documents"), F.lit(" "), F.col("entity"), F.lit(" up to page "), F.col("page"))
    return events.select(
        F.col("ts").alias("timestamp"), F.lit("load").alias("component"), F.lit("info").alias("level"),
        message.alias("message"), F.lit(None).cast("string").alias("details"),
    )
