"""Spreading parse-heavy work over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame

from entitylake.functions import variants as V


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by a well-distributed key if the input has fewer splits than cores.

    Parsing documents costs far more than moving them once, so a handful of
    large splits should not leave cores idle. Input with splits enough, as any
    large table has, is left alone: no shuffle is added there. Meant for scans:
    counting the splits of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, V.named(key))
