"""Load progress and the run registry, as append-only events.

Events: ``entity, kind, page, completed, ts, seq`` with kinds ``progress``,
``reset``, ``started``, ``stopped`` and, with entity NULL for all entities,
``reset_all`` and ``clear_running``. The current state is the last event that
concerns an entity, by (ts, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.specs import ENTITIES, canonical

PROGRESS_SCHEMA = "entity string, kind string, page int, completed boolean, ts timestamp, seq bigint"


def entity_names(df: DataFrame) -> DataFrame:
    """The fixed entities as a one-column frame; its size is a constant."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in ENTITIES])).alias("entity"))


def _last_state(events: DataFrame) -> DataFrame:
    """Per entity: last page state and last run state, with the times they date from."""
    order = F.struct("ts", "seq")
    kind = F.col("kind")
    paged = F.when(kind.isin("progress", "reset", "reset_all"), order)
    run = F.when(kind.isin("started", "stopped", "clear_running", "reset_all"), order)
    page_state = F.struct(
        F.when(kind == "progress", F.col("page")).otherwise(0).alias("last_page"),
        F.when(kind == "progress", F.col("completed")).otherwise(F.lit(False)).alias("completed"),
        F.when(kind == "progress", F.col("ts")).alias("last_update"),
        F.col("ts").alias("_paged_at"),
        F.col("seq").alias("_paged_seq"),
    )
    run_state = F.struct((kind == "started").alias("running"), F.col("ts").alias("_run_at"), F.col("seq").alias("_run_seq"))
    return events.groupBy(canonical(F.col("entity")).alias("entity")).agg(
        F.max_by(page_state, paged).alias("p"), F.max_by(run_state, run).alias("r")
    )


def export_status(events: DataFrame) -> DataFrame:
    """(entity, running, completed, last_page, last_update), never-seen fixed entities included."""
    seeds = entity_names(events).withColumn("kind", F.lit("seed"))
    state = _last_state(events.unionByName(seeds, allowMissingColumns=True))
    # Events for all entities are one row by now, which every entity's row meets.
    nobody = F.col("entity").isNull()
    for_all = state.filter(nobody).select(nobody.alias("_all"), F.col("p").alias("all_p"), F.col("r").alias("all_r"))
    own = state.filter(~nobody).withColumn("_all", ~nobody)
    own = own.join(F.broadcast(for_all), "_all", "left")
    p = F.when(_at("all_p", "_paged") > _at("p", "_paged"), F.col("all_p")).otherwise(F.col("p"))
    r = F.when(_at("all_r", "_run") > _at("r", "_run"), F.col("all_r")).otherwise(F.col("r"))
    return own.select("entity", p.alias("p"), r.alias("r")).select(
        "entity",
        F.coalesce("r.running", F.lit(False)).alias("running"),
        F.coalesce("p.completed", F.lit(False)).alias("completed"),
        F.coalesce("p.last_page", F.lit(0)).alias("last_page"),
        F.col("p.last_update").alias("last_update"),
    )


def _at(state: str, prefix: str) -> Column:
    return F.struct(F.col(f"{state}.{prefix}_at"), F.col(f"{state}.{prefix}_seq"))


def last_page(status: DataFrame, entity: str) -> int:
    row = status.filter(F.col("entity") == entity).select("last_page").first()
    return row.last_page if row else 0


def resume_points(status: DataFrame) -> DataFrame:
    """(entity, next_page): the page after the last one, 1 when there is none."""
    return status.select("entity", (F.greatest(F.col("last_page"), F.lit(0)) + 1).alias("next_page"))


def running(status: DataFrame) -> DataFrame:
    return status.filter("running").select("entity")


def verify_running(events: DataFrame, valid: DataFrame) -> DataFrame:
    """(entity, valid) per running entity; the invalid ones are to be stopped."""
    current = running(export_status(events))
    marked = valid.select(canonical(F.col("entity")).alias("entity")).distinct().withColumn("valid", F.lit(True))
    return current.join(marked, "entity", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def stop_events(verified: DataFrame) -> DataFrame:
    """Events that stop the running entities found invalid."""
    return verified.filter(~F.col("valid")).select(
        "entity",
        F.lit("stopped").alias("kind"),
        F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("boolean").alias("completed"),
        F.current_timestamp().alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
    )


def append_progress(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
