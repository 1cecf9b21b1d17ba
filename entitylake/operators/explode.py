"""Exploding computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positions(df: DataFrame, keep: list[Column], array: Column, element: str, position: str = "pos") -> DataFrame:
    """``keep`` columns with each array element and its position.

    The outer form plus a filter stands for the inner one: for an inner explode
    Catalyst infers a filter on the array's size and pushes it below the
    projections, which would parse the document once more for the filter and,
    inside a lambda, once per element.
    """
    exploded = df.select(*keep, F.posexplode_outer(array).alias(position, element))
    return exploded.filter(F.col(position).isNotNull())
