"""Custom fields across documents: dictionary, long form, discovered columns."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions.custom_fields import custom_field_headers, custom_fields
from entitylake.functions import variants as V
from entitylake.operators.explode import positions
from entitylake.session import stored
from entitylake.specs import CUSTOM_FIELDS

FIELDS = "_fields"


@dataclass(frozen=True, order=True)
class CustomColumn:
    field_id: str
    field_name: str
    field_type: str

    @property
    def workbook_name(self) -> str:
        return f"custom_{self.field_name}_{self.field_id}"


def with_fields(df: DataFrame, column: str = CUSTOM_FIELDS, headers_only: bool = False) -> DataFrame:
    """Add the normalised field array; rows without the column get an empty one."""
    read = custom_field_headers if headers_only else custom_fields
    if column not in df.columns:
        return df.withColumn(FIELDS, read(F.lit(None).cast("string"), T.StringType()))
    return df.withColumn(FIELDS, read(V.named(column), df.schema[column].dataType))


def field_key(field_id: Column, field_name: Column) -> Column:
    return F.concat(field_id, F.lit("\u0000"), field_name)


def _key_of(field: Column) -> Column:
    return field_key(field["field_id"], field["field_name"])


def last_per_key(df: DataFrame) -> DataFrame:
    """Keep the last field of each (id, name) within a document."""
    marked = df.withColumn("_rkeys", F.reverse(F.transform(FIELDS, _key_of))).withColumn("_n", F.size(FIELDS))
    kept = F.filter(FIELDS, lambda f, i: F.array_position("_rkeys", _key_of(f)) == (F.col("_n") - i).cast("bigint"))
    # Most documents repeat no field.
    plain = F.size(F.array_distinct("_rkeys")) == F.col("_n")
    return marked.withColumn(FIELDS, F.when(plain, F.col(FIELDS)).otherwise(kept)).drop("_rkeys", "_n")


def fields_long(df: DataFrame, keep: list[str], column: str = CUSTOM_FIELDS, headers_only: bool = False) -> DataFrame:
    """One row per document and field; later duplicates in a document win.

    ``headers_only`` leaves out ``field_values``.
    """
    narrow = df.select(*[V.named(c) for c in [*keep, column] if c in df.columns])
    latest = last_per_key(with_fields(narrow, column, headers_only))
    values = [] if headers_only else [F.col("f.field_values").alias("field_values")]
    return positions(latest, [V.named(c) for c in keep], F.col(FIELDS), "f").select(
        *[V.named(c) for c in keep],
        "pos",
        F.col("f.field_id").alias("field_id"),
        F.col("f.field_name").alias("field_name"),
        F.coalesce("f.field_type", F.lit("")).alias("own_type"),
        *values,
    )


def field_types(df: DataFrame, seen: str = "updated_at", key: str = "id", column: str = CUSTOM_FIELDS) -> DataFrame:
    """Dataset-wide dictionary (field_id, field_name) -> type; last seen wins.

    "Last" is by (``seen``, ``key``), then position; an id that is no number counts by its hash, and a missing or
    non-numeric ``seen`` is the earliest. The two BIGINTs are packed
    into one decimal so that the pass over all fields is a hash aggregation of
    fixed-width buffers with map-side combine: every document carries the same
    few fields, and a sort of the exploded rows would dominate the job.
    """
    far = 10**18
    moment = _number(df, seen)
    order = F.when(moment.isNull(), F.lit(-far)).otherwise(F.greatest(F.least(moment, F.lit(far)), F.lit(-far)))
    ids = F.coalesce(_number(df, key), F.xxhash64(_text(df, key)), F.lit(0)).cast("decimal(20,0)")
    packed = (order.cast("decimal(20,0)") * F.lit(Decimal(2**64)) + ids).cast("decimal(38,0)")
    entries = fields_long(df.select(packed.alias("_seen"), V.named(column)), ["_seen"], column, headers_only=True)
    last_of_each_type = entries.groupBy("field_id", "field_name", "own_type").agg(F.max("_seen").alias("last_seen"))
    return last_of_each_type.groupBy("field_id", "field_name").agg(
        F.max_by("own_type", F.struct("last_seen", "own_type")).alias("field_type")
    )


def _text(df: DataFrame, name: str) -> Column:
    """A column of any type as text, NULL where the frame has none."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    dtype = df.schema[name].dataType
    return V.text_of(V.as_variant(V.named(name), dtype)) if not isinstance(dtype, T.AtomicType) else V.named(name).cast("string")


def _number(df: DataFrame, name: str) -> Column:
    return _text(df, name).try_cast("bigint")


def custom_columns(df: DataFrame, **how: str) -> list[CustomColumn]:
    """Discovered custom columns, in (field id, name) order.

    Their number follows the field definitions, not the documents.
    """
    if how.get("column", CUSTOM_FIELDS) not in df.columns:
        return []
    rows = field_types(df, **how).collect()
    columns = [CustomColumn(r.field_id, r.field_name, r.field_type) for r in rows]
    return sorted(columns, key=lambda c: (not c.field_id.isdigit(), int(c.field_id) if c.field_id.isdigit() else 0, c))


def attach_types(long: DataFrame, types: DataFrame) -> DataFrame:
    """Join the dictionary to the long form; unknown fields get ``''``.

    The dictionary is written first, so that its size is known when the join is
    planned: a small one is broadcast and the long form, many times the documents'
    number of rows, is not shuffled. Otherwise adaptive execution splits hot fields.
    """
    joined = long.join(stored(types, "field-types"), ["field_id", "field_name"], "left")
    return joined.withColumn("field_type", F.coalesce("field_type", F.lit("")))
