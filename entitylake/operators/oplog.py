"""Operation log: append, recent entries, retention."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.functions import variants as V
from entitylake.session import scratch_dir

LOG_SCHEMA = "timestamp timestamp, component string, level string, message string, details string"
RETENTION_DAYS = 7  # Fixed value.


def append_log(entries: DataFrame, path: str) -> None:
    """Append entries, stamping those without a time, by day."""
    stamped = entries.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp()))
    stamped.withColumn("log_date", F.to_date("timestamp")).write.mode("append").partitionBy("log_date").parquet(path)


def recent_logs(
    logs: DataFrame,
    count: int = 100,
    message: str | None = None,
    level: str | None = None,
    literal: bool = False,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """The newest ``count`` entries after filtering; 0 means all.

    ``message`` is a case-insensitive regular expression, or plain text with
    ``literal``. ``level`` must match exactly. ``ties`` orders entries of one
    instant.
    """
    if level:
        logs = logs.filter(F.col("level") == level)
    if message:
        text = F.col("message")
        found = F.contains(F.lower(text), F.lit(message.lower())) if literal else text.rlike(f"(?i){message}")
        logs = logs.filter(found)
    newest = logs.orderBy(F.col("timestamp").desc(), *[V.named(t).desc() for t in ties])
    return newest.limit(count) if count else newest


def cutoff(now: datetime, days: int = RETENTION_DAYS) -> datetime:
    return now - timedelta(days=days)


def _utc(moment: datetime) -> datetime:
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def retained(logs: DataFrame, before: datetime) -> DataFrame:
    """Entries not older than the cutoff; one exactly at it stays.

    On a log written by ``append_log`` the date predicate prunes partitions.
    """
    before = _utc(before)
    kept = logs.filter(F.col("timestamp") >= F.lit(before))
    if "log_date" in logs.columns:
        kept = kept.filter(F.col("log_date") >= F.lit(before.astimezone(timezone.utc).date()))
    return kept


def drop_expired(spark: SparkSession, path: str, before: datetime) -> None:
    """Remove entries older than the cutoff from a log that ``append_log`` wrote.

    Whole days go with their folders. The day of the cutoff is written anew, from a copy, so that a failure on the
    way loses no entry that stays; other days are not touched.
    """
    before = _utc(before).astimezone(timezone.utc)
    day = before.date()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folders = {f.getPath().getName().removeprefix("log_date="): f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("log_date=")}
    if str(day) in folders and before.time() != datetime.min.time():
        logs = spark.read.parquet(path).filter(F.col("log_date") == F.lit(day))
        kept = logs.filter(F.col("timestamp") >= F.lit(before))
        copy = scratch_dir(spark, "log-day")
        kept.write.parquet(copy)
        kept = spark.read.schema(kept.schema).parquet(copy)
        if kept.isEmpty():
            files.delete(folders[str(day)], True)
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date").parquet(path)
    for name, folder in folders.items():
        if name < str(day):
            files.delete(folder, True)
