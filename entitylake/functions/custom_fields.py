"""Custom fields of one document as a normalised array, and their values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import variants as V

BAD_VALUES_CELL = "ERROR: values is not a list"

FIELD_TYPE = "array<struct<field_id:string,field_name:string,field_type:string,field_values:variant>>"
READ_TYPE = FIELD_TYPE.replace("field_values", "values")
HEADER_TYPE = READ_TYPE.replace(",values:variant", "")
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# Texts of an id that count as none.
NO_ID = ("", *V.EMPTY_TEXTS)


def custom_fields(value: Column, dtype: T.DataType) -> Column:
    """``ARRAY<STRUCT<field_id, field_name, field_type, field_values>>``.

    Accepts a typed list, a VARIANT list or the JSON text of a list; anything
    else is an empty array. Elements that are not objects, or lack a name or
    an id, are skipped. Order is the document's. ``field_values`` stays VARIANT,
    to be opened only where a cell asks for it.
    """
    fields = F.filter(_elements(value, dtype), _eligible)
    return F.coalesce(fields.cast(FIELD_TYPE), F.array().cast(FIELD_TYPE))


def custom_field_headers(value: Column, dtype: T.DataType) -> Column:
    """``custom_fields`` without the values, whose text is then skipped unread."""
    fields = F.filter(_elements(value, dtype, HEADER_TYPE), _eligible)
    return F.coalesce(fields.cast(HEADER_TYPE), F.array().cast(HEADER_TYPE))


def _eligible(field: Column) -> Column:
    return F.coalesce((field["field_name"] != "") & ~field["field_id"].isin(*NO_ID), F.lit(False))


def _elements(value: Column, dtype: T.DataType, read_type: str = READ_TYPE) -> Column:
    if isinstance(dtype, T.StringType):
        # The typed reader is several times faster than VARIANT paths, but takes
        # an object for a list of one and gives up on lists with other elements.
        text = F.trim(value)
        is_list_text = text.startswith("[") & text.endswith("]")
        # As the only element of a list, text that goes on after its own list is malformed.
        wrapped = F.from_json(F.concat(F.lit('{"v":['), value, F.lit("]}")), f"struct<v:array<{read_type}>>", STRICT_JSON)
        typed = V.once(wrapped["v"], lambda v: F.when(F.size(v) == 1, F.get(v, 0)))
        loose = _loose(V.parsed(value, dtype), read_type)
        return F.when(is_list_text, F.coalesce(typed, loose))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return F.transform(value, lambda f: _typed_element(f, dtype.elementType, read_type))
    if isinstance(dtype, T.VariantType):
        # Only what is no list is taken for text.
        return _of_list(F.coalesce(V.as_list(value), V.as_list(V.strict_json(V.text_of(value)))), read_type)
    return _loose(V.parsed(value, dtype), read_type)


def _members(read_type: str) -> list[str]:
    names = ["field_id", "field_name", "field_type"]
    return names + ["values"] if read_type == READ_TYPE else names


def _loose(value: Column, read_type: str) -> Column:
    return _of_list(V.as_list(value), read_type)


def _of_list(elements: Column, read_type: str) -> Column:
    def member(element: Column, name: str) -> Column:
        return V.at(element, f"$.{name}", "variant" if name == "values" else "string").alias(name)

    return F.transform(elements, lambda e: F.struct(*[member(e, n) for n in _members(read_type)]))


def _typed_element(element: Column, dtype: T.StructType, read_type: str) -> Column:
    kinds = {f.name: f.dataType for f in dtype.fields}

    def member(name: str) -> Column:
        as_type = "variant" if name == "values" else "string"
        if name not in kinds:
            return F.lit(None).cast(as_type).alias(name)
        got = element[name]
        return (V.as_variant(got, kinds[name]) if as_type == "variant" else got.cast("string")).alias(name)

    return F.struct(*[member(n) for n in _members(read_type)])


def has_values(field_values: Column) -> Column:
    """A list with elements, or anything else that counts as given."""
    return F.when(V.at(field_values, "$[0]").isNotNull(), True).otherwise(V.truthy(field_values))


def is_list(field_values: Column) -> Column:
    """A list with elements."""
    return V.at(field_values, "$[0]").isNotNull()


def joined_values(field_values: Column) -> Column:
    """All values as one text in document order; nulls leave no trace."""
    texts = F.transform(V.as_list(field_values), lambda v: V.at(v, "$.value", "string"))
    return F.coalesce(F.array_join(texts, ", "), F.lit(""))


def first_value(field_values: Column) -> Column:
    """VARIANT of the first value, NULL when the first element carries none."""
    return V.at(field_values, "$[0].value")
