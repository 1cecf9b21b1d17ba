"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Runtime settings with a meaning for results, not for speed:
# cells and epochs are UTC; headers differing only in case are different
# columns; a repeated JSON key keeps its last value.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "entitylake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.scheduler.mode": "FAIR",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach, below ``spark.checkpoint.dir``.

    Where the setting is absent a local temporary folder stands in, for a
    session whose executors are this very process; any other session needs it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: what reads them more than once computes them once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def _local_folder() -> str:
    """One folder per process, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="scratch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
