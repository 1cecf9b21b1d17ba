"""Loads that continue where they stopped.

The checkpoint of a query is its progress: it moves on after a batch is
written, so a stop or a crash between the two repeats the batch, whose rows the
sink replaces. Restarting from scratch means a new checkpoint folder; the
stored rows stay and the replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from entitylake.functions import variants as V
from entitylake.operators.filters import updated_range
from entitylake.operators.oplog import append_log
from entitylake.operators.pages import PAGE_SIZE, explode_envelopes
from entitylake.operators.progress import PROGRESS_SCHEMA, append_progress
from entitylake.sources.history import ARRIVED, History, exists
from entitylake.sources.landing import quarantined, stream_pages
from entitylake.specs import DELETE_VERB, ENTITIES, EVENT_VERBS, canonical_name
from entitylake.streaming.traces import LOAD, measured


# -- routing -------------------------------------------------------------------

def event_types() -> dict[str, str]:
    """The routed webhook types and the entity each concerns."""
    return {f"{verb}_{spec.event_noun}": spec.name for spec in ENTITIES.values() for verb in EVENT_VERBS}


def routed_entity(event_type: Column, routes: dict[str, str] | None = None) -> Column:
    """Entity an event type concerns; NULL for unknown or missing types."""
    routed = F.lit(None).cast("string")
    by_entity: dict[str, list[str]] = {}
    for kind, entity in (event_types() if routes is None else routes).items():
        by_entity.setdefault(entity, []).append(kind)
    for entity, kinds in by_entity.items():
        routed = F.when(event_type.isin(*kinds), F.lit(entity)).otherwise(routed)
    return routed


def is_delete(event_type: Column) -> Column:
    return event_type.startswith(DELETE_VERB + "_")


# -- queries -------------------------------------------------------------------

def load_pages(
    spark: SparkSession,
    landing: str,
    entity: str,
    table: History,
    checkpoint: str,
    to_rows: Callable[[DataFrame], DataFrame],
    pages_per_batch: int = 10,
    whole_files: bool = False,
    date_from: str | None = None,
    date_to: str | None = None,
) -> StreamingQuery:
    """Landed pages of an entity appended to its table.

    ``to_rows`` turns (entity, source, page, pos, doc) into table rows and keeps page and position, by which the
    table is ordered, so the result does not depend on the batch size. A date range limits documents by their
    ``updated_at``. Pages that are no JSON have no rows; ``quarantine_pages`` keeps them. Within ``traces.traced``
    every batch leaves a progress event.
    """
    pages = stream_pages(spark, landing, entity, pages_per_batch, whole_files).drop("raw")
    documents = measured(explode_envelopes(pages, entity))
    if date_from or date_to:
        documents = documents.withColumn("_updated", V.at(F.col("doc"), "$.updated_at"))
        documents = updated_range(documents, date_from, date_to, column="_updated").drop("_updated")
    return table.stream(to_rows(documents), checkpoint, f"{LOAD}{entity}")


def record_load(table: History, entity: str, progress_path: str, log_path: str, page_size: int = PAGE_SIZE) -> None:
    """Leave the load's traces: a progress event and a log entry per page that has arrived since the last call.

    A page with fewer documents than a full one completes the entity. Events carry the time at which their page
    arrived, so a call after a reset, with nothing new, doesn't undo it; events of one time are ordered by page.
    """
    sizes = table.changes().groupBy("page").agg(F.count("*").alias("n"), F.max(ARRIVED).alias("arrived"))
    name = F.lit(canonical_name(entity))
    if exists(table.spark, progress_path):
        told = table.spark.read.schema(PROGRESS_SCHEMA).parquet(progress_path).filter((F.col("entity") == name) & (F.col("kind") == "progress"))
        if (last := told.agg(F.max("ts").alias("ts")).first()["ts"]) is not None:
            sizes = sizes.filter(F.col("arrived") > F.lit(last))
    events = sizes.select(
        name.alias("entity"),
        F.lit("progress").alias("kind"),
        F.col("page").cast("int").alias("page"),
        (F.col("n") < page_size).alias("completed"),
        F.col("arrived").alias("ts"),
        F.col("page").cast("bigint").alias("seq"),
    )
    append_progress(events, progress_path)
    message = F.concat(F.lit("Loaded "), F.col("n"), F.lit(" "), name, F.lit(" of page "), F.col("page"))
    entries = sizes.select(
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit("load").alias("component"),
        F.lit("info").alias("level"),
        message.alias("message"),
        F.lit(None).cast("string").alias("details"),
    )
    append_log(entries, log_path)


def quarantine_pages(
    spark: SparkSession, landing: str, entity: str, out: str, checkpoint: str, pages_per_batch: int = 10, whole_files: bool = False
) -> StreamingQuery:
    """Landed text of an entity that is no JSON, kept with its source in parquet below ``out``."""
    bad = quarantined(stream_pages(spark, landing, entity, pages_per_batch, whole_files))
    return (
        bad.select("entity", "source", "raw")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .queryName(f"quarantine-{entity}")
        .trigger(availableNow=True)
        .start()
    )


def without_replays(webhooks: DataFrame, window: str) -> DataFrame:
    """A stream of events without bodies that were received before, no longer than ``window`` ago.

    The state is one digest per different body of the window, shuffled by it. Late data: an event received more than
    ``window`` before the newest one of earlier batches is taken for a replay and dropped, which the query's progress counts
    (``numRowsDroppedByWatermark``); so ``window`` must exceed the delay of delivery. A body that comes again later than
    that is a new event.
    """
    keyed = webhooks.withColumn("_body_digest", F.sha2(F.col("raw"), 256)).withWatermark("_received_at", window)
    return keyed.dropDuplicatesWithinWatermark(["_body_digest"]).drop("_body_digest")


def apply_webhooks(
    webhooks: DataFrame,
    tables: dict[str, History],
    checkpoint: str,
    archive: str,
    reload: Callable[[str, int], None] | None = None,
    apply_deletes: bool = False,
    id_path: str = "$.id",
    routes: dict[str, str] | None = None,
) -> StreamingQuery:
    """Store landed events below ``archive`` and reload each entity they touch, once per batch.

    ``apply_deletes`` also removes the ids of delete events, which the plain
    feed leaves alone. A batch is parsed once, for the archive; the rest reads that.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        folder = f"{archive.rstrip('/')}/batch={batch_id}"
        routed = batch.select(
            "event_type",
            routed_entity(F.col("event_type"), routes).alias("entity"),
            V.at(F.col("body"), id_path, "string").alias("object_id"),
            "raw",
            "_received_at",
        )
        routed.write.mode("overwrite").parquet(folder)
        stored = batch.sparkSession.read.schema(routed.schema).parquet(folder)
        # At most the names in the routes.
        touched = [r.entity for r in stored.select("entity").filter("entity is not null").distinct().collect()]
        for entity in sorted(touched):
            if reload:
                reload(entity, batch_id)
            if apply_deletes and entity in tables:
                ids = stored.filter((F.col("entity") == entity) & is_delete(F.col("event_type")))
                tables[entity].delete(ids.select(F.col("object_id").alias(tables[entity].key)))

    return (
        webhooks.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .queryName("webhooks")
        .trigger(availableNow=True)
        .start()
    )


def reload_landed(
    spark: SparkSession,
    landing: str,
    tables: dict[str, History],
    checkpoints: str,
    to_rows: dict[str, Callable[[DataFrame], DataFrame]],
    **how: object,
) -> Callable[[str, int], None]:
    """``reload`` for ``apply_webhooks``: load what has landed for an entity since its last load.

    Pages of an entity land below ``<landing>/<entity>``. The load's own
    checkpoint remembers the place, so a repeated webhook batch reloads nothing.
    """

    def reload(entity: str, _: int) -> None:
        if entity in tables:
            load_pages(
                spark, f"{landing}/{entity}", entity, tables[entity], f"{checkpoints}/{entity}", to_rows[entity], **how
            ).awaitTermination()

    return reload


def run_entities(starts: dict[str, Callable[[], StreamingQuery]]) -> list[tuple[str, str, str | None]]:
    """Start one query per entity, wait for all; (entity, status, error) each.

    The queries share the session and run side by side; one that fails leaves
    the others alone.
    """
    running: dict[str, StreamingQuery] = {}
    report: dict[str, tuple[str, str | None]] = {}
    for entity, start in starts.items():
        try:
            running[entity] = start()
        except Exception as error:
            report[entity] = ("failed", str(error))
    for entity, query in running.items():
        try:
            query.awaitTermination()
            report[entity] = ("completed", None)
        except Exception as error:
            report[entity] = ("failed", str(error))
    return [(entity, *report[entity]) for entity in starts]


def stop_all(spark: SparkSession, names: Sequence[str] | None = None) -> None:
    """Stop queries between batches; their checkpoints keep the place."""
    for query in spark.streams.active:
        if names is None or query.name in names:
            query.stop()
