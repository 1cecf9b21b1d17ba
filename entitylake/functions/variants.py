"""Reading loosely typed JSON values through VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts of the values that count as "nothing" unless they are strings.
EMPTY_TEXTS = ("0", "0.0", "false", "[]", "{}")


def named(name: str) -> Column:
    """Column by its exact name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` reads it.

    A column that is named several times within a higher-order function is computed as many times.
    """
    return F.get(F.transform(F.array(value), use), 0)


def null_variant() -> Column:
    return F.lit(None).cast("variant")


def at(value: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(value, path, as_type)


def text_of(value: Column) -> Column:
    """Strings as they are, everything else as compact JSON, null as NULL."""
    return at(value, "$", "string")


def shape_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or NUMBER."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT"), "OBJECT")
        .when(schema.startswith("ARRAY"), "ARRAY")
        .when(schema.isin("STRING", "BOOLEAN", "VOID"), schema)
        .otherwise("NUMBER")
    )


def truthy(value: Column) -> Column:
    """Present and neither null, false, zero nor empty."""
    text = text_of(value)
    decided = F.when(text.isin(*EMPTY_TEXTS), F.schema_of_variant(value) == "STRING").otherwise(text != "")
    return F.coalesce(decided, F.lit(False))


def as_variant(value: Column, dtype: T.DataType) -> Column:
    """Any column as VARIANT; text stays a string value."""
    if isinstance(dtype, T.VariantType):
        return value
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(value)
    return value.cast("variant")


def strict_json(text: Column) -> Column:
    """VARIANT of JSON text; NULL for text that goes on after its value, which the parser alone takes.

    Such text is no JSON as the only element of a list, or else not as the member of an object.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    # What ends the list early is no JSON in the object, so whether that one reads at all is enough.
    return once(listed, lambda of_list: F.when(at(of_list, "$[1]").isNull() & member.isNotNull(), at(of_list, "$[0]")))


def size_of(value: Column) -> Column:
    return F.size(F.map_keys(as_map(value)))


def parsed(value: Column, dtype: T.DataType) -> Column:
    """VARIANT of a value that may itself be JSON text; bad JSON gives NULL."""
    if isinstance(dtype, T.StringType):
        return strict_json(value)
    if isinstance(dtype, T.VariantType):
        return F.when(F.schema_of_variant(value) == "STRING", strict_json(text_of(value))).otherwise(value)
    return as_variant(value, dtype)


def as_list(value: Column) -> Column:
    """ARRAY<VARIANT>, or NULL when the value is not a list."""
    return value.try_cast("array<variant>")


def as_map(value: Column) -> Column:
    """MAP<STRING, VARIANT>, or NULL when the value is not an object."""
    return value.try_cast("map<string,variant>")
