"""Wide tables in the two delivery layouts.

A document carries all of its fields, so a wide row is built from that row
alone: discovered columns become lookups in the row's own field array. Neither
layout explodes, groups or shuffles; the only pass besides the row-wise one is
the column discovery, which reads the custom-field column alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import cells
from entitylake.functions import custom_fields as C
from entitylake.functions import links
from entitylake.functions import variants as V
from entitylake.operators.fields import (
    FIELDS,
    CustomColumn,
    attach_types,
    field_key,
    fields_long,
    with_fields,
)
from entitylake.specs import CUSTOM_FIELDS, EMPTY_AS_BLANK, EPOCH_FIELDS, FIRST_VALUE_TYPES, LINK_URL, LINKS

ERRORS = "_errors"
SPECIAL = (LINKS, CUSTOM_FIELDS)
PARSED_TYPES = {"numeric", "date", "datetime"}


def base_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SPECIAL]


def _found(names: str, fields: str, wanted: Column) -> Column:
    """Last field of the row with that key; NULL when it has none."""
    return F.get(fields, (F.array_position(names, wanted) - 1).cast("int"))


# -- values of the wanted fields, in stages ----------------------------------------

def with_values(
    df: DataFrame, wanted: list[tuple[str, Column, set[str]]], type_column: str | None = None
) -> DataFrame:
    """Add, per wanted (prefix, field struct, types), what its cells are made of.

    ``<prefix>_f`` is the field, ``_v`` its first value, ``_t`` and ``_k`` that
    value's text and kind, ``_n`` its number, ``_date`` and ``_datetime`` its
    moments, as far as the types call for them. Each stage is a projection of
    its own, so that a value is looked up and parsed once however many
    expressions read it. Where the type is a column, only rows of a type are
    parsed for it.
    """

    def only(value: Column, *types: str) -> Column:
        return F.when(F.col(type_column).isin(*types), value) if type_column else value

    df = _add(df, {f"{p}_f": field for p, field, _ in wanted})
    df = _add(df, {f"{p}_v": C.first_value(F.col(f"{p}_f.field_values")) for p, _, _ in wanted})
    scalar = [(p, types) for p, _, types in wanted if types & set(FIRST_VALUE_TYPES)]
    df = _add(df, {f"{p}_t": V.text_of(F.col(f"{p}_v")) for p, _ in scalar})
    parsed = [(p, types) for p, types in scalar if types & PARSED_TYPES]
    df = _add(df, {f"{p}_k": only(F.schema_of_variant(f"{p}_v"), *PARSED_TYPES) for p, _ in parsed})
    stage = {}
    for p, types in parsed:
        text, kind = F.col(f"{p}_t"), F.col(f"{p}_k")
        if "numeric" in types:
            stage[f"{p}_n"] = only(cells.number_of(text, kind), "numeric")
        for moment in sorted(types & {"date", "datetime"}):
            stage[f"{p}_{moment}"] = only(cells.moment_of(text, kind, moment), moment)
    return _add(df, stage)


def _add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns) if columns else df


def sheet_value(prefix: str, field_type: str) -> tuple[Column, Column]:
    """Sheet cell of non-empty values under a type, and whether it failed."""
    text, kind = F.col(f"{prefix}_t"), F.col(f"{prefix}_k")
    never = F.lit(False)
    if field_type == "numeric":
        return cells.number_text(F.col(f"{prefix}_n"), text), never
    if field_type in ("date", "datetime"):
        moment = F.col(f"{prefix}_{field_type}")
        return cells.moment_cell(moment, text, field_type), cells.moment_failed(moment, text, kind)
    if field_type in FIRST_VALUE_TYPES:
        return F.when(F.col(f"{prefix}_v").isNull(), "").otherwise(text), never
    return C.joined_values(F.col(f"{prefix}_f.field_values")), never


def whole_sheet_value(prefix: str, by_type: list[tuple[Column | None, str]]) -> tuple[Column, Column]:
    """Sheet cell of a field whose type is the first whose condition holds.

    A condition of None always holds.
    """
    cell, failure = F.lit(None).cast("string"), F.lit(False)
    for condition, field_type in reversed(by_type):
        this_cell, this_failure = sheet_value(prefix, field_type)
        if condition is None:
            cell, failure = this_cell, this_failure
        else:
            cell = F.when(condition, this_cell).otherwise(cell)
            failure = F.when(condition, this_failure).otherwise(failure)
    values = F.col(f"{prefix}_f.field_values")
    listed = C.is_list(values)
    bad = V.truthy(values)
    shown = F.when(listed, cell).when(bad, C.BAD_VALUES_CELL).otherwise("")
    return shown, F.when(listed, failure).otherwise(bad)


# -- workbook layout ------------------------------------------------------------

def workbook_table(df: DataFrame, columns: list[CustomColumn], typed: bool = False) -> DataFrame:
    """Base columns, `link_url`, then one column per field id and name.

    ``typed`` gives numeric, date and datetime fields real types instead of
    the raw text of the value.
    """
    usable = F.filter(FIELDS, lambda f: C.has_values(f["field_values"]))
    prepared = with_fields(df).withColumn("_found", F.reverse(usable))
    prepared = prepared.withColumn("_keys", F.transform("_found", lambda f: field_key(f["field_id"], f["field_name"])))
    wanted = [
        (f"_{i}", _found("_keys", "_found", field_key(F.lit(column.field_id), F.lit(column.field_name))), {column.field_type} if typed else set())
        for i, column in enumerate(columns)
    ]
    selected = [_workbook_base(V.named(c), df.schema[c].dataType).alias(c) for c in base_columns(df) if c != LINK_URL]
    if LINKS in df.columns:
        own = V.named(LINK_URL) if LINK_URL in df.columns else F.lit(None)
        link = links.workbook_link(V.named(LINKS), df.schema[LINKS].dataType)
        selected.append(F.coalesce(link, own.cast("string")).alias(LINK_URL))
    elif LINK_URL in df.columns:
        selected.append(V.named(LINK_URL))
    for i, column in enumerate(columns):
        value = _typed_value(f"_{i}", column) if typed else _raw_value(f"_{i}", column)
        selected.append(value.alias(column.workbook_name))
    return with_values(prepared, wanted).select(*selected)


def _workbook_base(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return V.text_of(value)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value


def _raw_value(prefix: str, column: CustomColumn) -> Column:
    values = F.col(f"{prefix}_f.field_values")
    if column.field_type in FIRST_VALUE_TYPES:
        first = F.col(f"{prefix}_v")
        text = F.when(first.isNull(), "").otherwise(V.text_of(first))
    else:
        text = C.joined_values(values)
    return F.when(C.is_list(values), text).when(F.col(f"{prefix}_f").isNotNull(), C.BAD_VALUES_CELL)


def _typed_value(prefix: str, column: CustomColumn) -> Column:
    if column.field_type == "numeric":
        return F.col(f"{prefix}_n")
    if column.field_type == "date":
        return F.col(f"{prefix}_date").cast("date")
    if column.field_type == "datetime":
        return F.col(f"{prefix}_datetime")
    return _raw_value(prefix, column)


# -- sheet layout ---------------------------------------------------------------

def sheet_plan(
    df: DataFrame, columns: list[CustomColumn], around: tuple[str, ...] = ()
) -> tuple[DataFrame, dict[str, Column], Column]:
    """The frame cells are read from, the cell per header (sorted), and the failed headers.

    ``around`` names columns that are not part of the document.
    """
    source = (
        with_fields(df)
        .withColumn("_found", F.reverse(FIELDS))
        .withColumn("_names", F.transform("_found", lambda f: f["field_name"]))
    )
    out: dict[str, Column] = {}
    failed: list[Column] = []
    probes: dict[str, Column] = {}
    for number, name in enumerate(c for c in base_columns(df) if c not in around):
        value, dtype = V.named(name), df.schema[name].dataType
        if name in EPOCH_FIELDS:
            text, kind = f"_e{number}_t", f"_e{number}_k"
            probes[text], probes[kind] = _text_and_kind(value, dtype)
            out[name] = cells.top_level_cell(F.col(text), F.col(kind))
            failed.append(F.when(cells.top_level_failed(F.col(text), F.col(kind)), F.lit(name)))
        else:
            out[name] = cells.base_cell(value, dtype, name in EMPTY_AS_BLANK)
    if LINKS in df.columns and not isinstance(df.schema[LINKS].dataType, T.StringType):
        link = links.sheet_link(V.named(LINKS), df.schema[LINKS].dataType)
        out[LINK_URL] = F.coalesce(link, out[LINK_URL]) if LINK_URL in out else link
    wanted = []
    for number, (name, by_type) in enumerate(_by_name(columns).items()):
        prefix = f"_{number}"
        wanted.append((prefix, _found("_names", "_found", F.lit(name)), set(by_type)))
        field = F.col(f"{prefix}_f")
        conditions = [(field["field_id"].isin(*ids), field_type) for field_type, ids in by_type.items()]
        conditions[-1] = (None, conditions[-1][1])
        cell, failure = whole_sheet_value(prefix, conditions)
        out[name] = F.when(field.isNotNull(), cell).otherwise(out.get(name, F.lit(None).cast("string")))
        failed.append(F.when(failure, F.lit(name)))
    finished = {name: F.coalesce(cells.plus_guard(cell), F.lit("")) for name, cell in sorted(out.items())}
    errors = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return with_values(_add(source, probes), wanted), finished, errors


def _text_and_kind(value: Column, dtype: T.DataType) -> tuple[Column, Column]:
    if isinstance(dtype, T.VariantType):
        return V.text_of(value), F.schema_of_variant(value)
    kind = "STRING" if isinstance(dtype, T.StringType) else "BIGINT"
    return value.cast("string"), F.lit(kind)


def sheet_table(df: DataFrame, columns: list[CustomColumn], errors: bool = False) -> DataFrame:
    """One text column per header; nothing is NULL."""
    source, by_header, failed = sheet_plan(df, columns)
    selected = [cell.alias(header) for header, cell in by_header.items()]
    return source.select(*selected, *([failed.alias(ERRORS)] if errors else []))


def sheet_rows(
    df: DataFrame, columns: list[CustomColumn], around: tuple[str, ...] = ()
) -> tuple[list[str], DataFrame]:
    """The headers, and per row the ``around`` columns, its cells in header order and its errors."""
    source, by_header, failed = sheet_plan(df, columns, around)
    row = F.array(*by_header.values()).alias("cells")
    return list(by_header), source.select(*[V.named(c) for c in around], row, failed.alias(ERRORS))


def _by_name(columns: list[CustomColumn]) -> dict[str, dict[str, list[str]]]:
    """Field ids by type, per custom name."""
    names: dict[str, dict[str, list[str]]] = {}
    for column in columns:
        names.setdefault(column.field_name, {}).setdefault(column.field_type, []).append(column.field_id)
    return names


# -- long form --------------------------------------------------------------------

def custom_values(df: DataFrame, types: DataFrame, keep: list[str]) -> DataFrame:
    """Long form with both texts of a field: as the workbook and as the sheet shows it."""
    typed = attach_types(fields_long(df, keep), types)
    field = F.struct("field_id", "field_values")
    valued = with_values(typed, [("_x", field, set(FIRST_VALUE_TYPES))], "field_type")
    kind = F.col("field_type")
    by_type = [(kind == known, known) for known in FIRST_VALUE_TYPES] + [(None, "")]
    sheet, _ = whole_sheet_value("_x", by_type)
    first = F.when(F.col("_x_v").isNull(), "").otherwise(F.col("_x_t"))
    values = F.col("field_values")
    joined = C.joined_values(values)
    workbook = F.when(kind.isin(*FIRST_VALUE_TYPES), first).otherwise(joined)
    return valued.select(
        *[V.named(c) for c in keep],
        "pos",
        "field_id",
        "field_name",
        "field_type",
        F.when(C.is_list(values), workbook).when(V.truthy(values), C.BAD_VALUES_CELL).alias("workbook_value"),
        F.coalesce(cells.plus_guard(sheet), F.lit("")).alias("sheet_value"),
    )
