"""Row filters of the load and export jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import variants as V
from entitylake.functions.dates import argument_epoch


def updated_range(
    df: DataFrame, date_from: str | None = None, date_to: str | None = None, column: str = "updated_at"
) -> DataFrame:
    """Inclusive range of an epoch column, either end optional.

    Numeric and timestamp columns give predicates the scan can push down. A VARIANT
    column matches only where it holds a number, never a text of digits; a
    text column therefore never matches.
    """
    if not date_from and not date_to:
        return df
    low = argument_epoch(date_from) if date_from else None
    high = argument_epoch(date_to) if date_to else None
    dtype = df.schema[column].dataType
    value = V.named(column)
    if isinstance(dtype, T.StringType):
        return df.filter(F.lit(False))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return _moment_range(df, value, dtype, low, high)
    if isinstance(dtype, T.VariantType):
        value = F.when(V.shape_of(value) == "NUMBER", V.at(value, "$", "double"))
    if low is not None:
        df = df.filter(value >= F.lit(low))
    if high is not None:
        df = df.filter(value <= F.lit(high))
    return df


def _moment_range(df: DataFrame, value: Column, dtype: T.DataType, low: int | None, high: int | None) -> DataFrame:
    """The same range on a timestamp column, to the second, as literals the scan understands."""

    def bound(epoch: int) -> Column:
        return F.timestamp_seconds(F.lit(epoch)).cast(dtype)

    if low is not None:
        df = df.filter(value >= bound(low))
    if high is not None:
        df = df.filter(value < bound(high + 1))
    return df


def point_lookup(df: DataFrame, key_value: object, key: str = "id") -> DataFrame:
    """The rows of one id; none when it is unknown."""
    return df.filter(V.named(key) == F.lit(key_value))
