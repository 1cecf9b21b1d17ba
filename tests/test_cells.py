"""Cell rules, edge case by edge case (FIXTURES section 3)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import cells, links
from entitylake.functions import variants as V
from entitylake.operators import fields, layouts

HEAD = '[{"field_id": %s, "field_name": "%s", "field_type": "%s", "values": %s}]'


def field_cells(spark, field_type, values):
    """(workbook, sheet, errors) of a document with one field."""
    text = HEAD % (10, "Stage", field_type, values)
    df = spark.createDataFrame([(1, 1, text)], "id long, updated_at long, custom_fields_values string")
    columns = fields.custom_columns(df)
    book = layouts.workbook_table(df, columns).first()["custom_Stage_10"]
    sheet = layouts.sheet_table(df, columns, errors=True).first()
    return book, sheet["Stage"], sheet["_errors"]


@pytest.mark.parametrize(
    "field_type, values, book, sheet",
    [
        ("numeric", '[{"value": "12.0"}]', "12.0", "12"),
        ("numeric", '[{"value": "12.5"}]', "12.5", "12.5"),
        ("numeric", '[{"value": "abc"}]', "abc", "abc"),
        ("numeric", '[{"value": "1_000"}]', "1_000", "1000"),
        ("numeric", '[{"value": "12d"}]', "12d", "12d"),
        ("numeric", '[{"value": true}]', "true", "1"),
        ("numeric", '[{"value": null}]', None, ""),
        ("numeric", '[{"value": 12345678.25}]', "12345678.25", "12345678.25"),
        ("numeric", '[{"value": 0.0004}]', "0.0004", "0.0004"),
        ("numeric", '[{"value": "1.5e-4"}]', "1.5e-4", "0.00015"),
        ("numeric", '[{"value": 1e20}]', "1.0E20", "100000000000000000000"),
        ("date", '[{"value": 1700000000}]', "1700000000", "=DATE(2023;11;14)"),
        ("datetime", '[{"value": 1700000000}]', "1700000000", "=DATE(2023;11;14) + TIME(22;13;20)"),
        ("datetime", '[{"value": "1700000000"}]', "1700000000", "=DATE(2023;11;14) + TIME(22;13;20)"),
        ("date", '[{"value": "2024-1-2"}]', "2024-1-2", "=DATE(2024;1;2)"),
        ("date", '[{"value": "2024-2-30"}]', "2024-2-30", "2024-2-30"),
        ("datetime", '[{"value": "2024-01-02"}]', "2024-01-02", "=DATE(2024;1;2) + TIME(0;0;0)"),
        ("datetime", '[{"value": "2024-01-02 03:04:05"}]', "2024-01-02 03:04:05", "=DATE(2024;1;2) + TIME(3;4;5)"),
        ("date", '[{"value": "2024-01-02T00:00:00"}]', "2024-01-02T00:00:00", "2024-01-02T00:00:00"),
        ("multiselect", '[{"value": "a"}, {"value": "b"}]', "a, b", "a, b"),
        ("multiselect", '[{"value": "a"}, {"value": null}, {"value": "b"}]', "a, b", "a, b"),
        ("multiselect", '[{"value": "a"}, 3, {"other": 1}]', "a", "a"),
        ("custom", '[{"value": "+1"}, {"value": "+2"}]', "+1, +2", "'+1, +2"),
        ("text", '[{"value": "+100"}]', "+100", "'+100"),
        ("select", '[{"other": 1}]', "", ""),
        ("checkbox", '[{"value": true}]', "true", "true"),
    ],
)
def test_field_cells(spark, field_type, values, book, sheet):
    assert field_cells(spark, field_type, values)[:2] == (book, sheet)


def test_empty_values_differ_by_layout(spark):
    assert field_cells(spark, "text", "[]")[:2] == (None, "")


def test_values_that_are_no_list_are_an_error(spark):
    book, sheet, errors = field_cells(spark, "text", '{"value": 1}')
    assert book == sheet == "ERROR: values is not a list"
    assert errors == ["Stage"]


def test_far_epoch_is_raw_and_reported(spark):
    assert field_cells(spark, "date", '[{"value": 99999999999999999}]') == (
        "99999999999999999",
        "99999999999999999",
        ["Stage"],
    )


@pytest.mark.parametrize(
    "text, cell, failed",
    [
        ("1700000000", "=DATE(2023;11;14) + TIME(22;13;20)", False),
        ("0", "0", False),
        ("99999999999999999", "99999999999999999", True),
        ("100000000000000000000", "100000000000000000000", True),
        ("null", None, False),
        ('"\'1700000000"', "=DATE(2023;11;14) + TIME(22;13;20)", False),
        ('""', "", False),
        ("-1", "=DATE(1969;12;31) + TIME(23;59;59)", False),
    ],
)
def test_top_level_epoch(spark, text, cell, failed):
    probe = spark.range(1).select(F.parse_json(F.lit(text)).alias("v"))
    row = probe.select(
        cells.top_level_cell(V.text_of(F.col("v")), F.schema_of_variant("v")).alias("cell"),
        cells.top_level_failed(V.text_of(F.col("v")), F.schema_of_variant("v")).alias("failed"),
    ).first()
    assert (row.cell, row.failed) == (cell, failed)


def test_plus_guard_is_applied_once(spark):
    row = spark.range(1).select(cells.plus_guard(cells.plus_guard(F.lit("+1"))).alias("c")).first()
    assert row.c == "'+1"


def test_nested_and_empty_base_values(spark):
    df = spark.createDataFrame(
        [(1, [], [], {"a": 1}, None)], "id long, tags array<string>, extra array<string>, m map<string,int>, gone string"
    )
    row = layouts.sheet_table(df, []).first().asDict()
    assert row == {"id": "1", "tags": "", "extra": "[]", "m": '{"a":1}', "gone": ""}


@pytest.mark.parametrize(
    "links_json, book, sheet",
    [
        ('{"self": {"href": "u"}}', "u", "u"),
        ('"{\\"self\\": {\\"href\\": \\"u\\"}}"', "u", None),
        ('"junk"', "junk", None),
        ('"{\\"other\\": 1}"', None, None),
        ("{}", None, None),
        ("null", None, None),
        ("[1]", "[1]", None),
        ('{"self": 1}', '{"self":1}', None),
        ('{"self": {"href": ""}}', None, ""),
    ],
)
def test_links(spark, links_json, book, sheet):
    variant = T.VariantType()
    row = (
        spark.range(1)
        .select(F.parse_json(F.lit(links_json)).alias("v"))
        .select(links.workbook_link(F.col("v"), variant).alias("b"), links.sheet_link(F.col("v"), variant).alias("s"))
        .first()
    )
    assert (row.b, row.s) == (book, sheet)


@pytest.mark.parametrize("text", ['{"field_id": 16}', "not json", "", "null", "[", '[{"field_id": 1}] junk'])
def test_what_is_no_list_has_no_fields(spark, text):
    df = spark.createDataFrame([(1, 1, text)], "id long, updated_at long, custom_fields_values string")
    assert fields.fields_long(df, ["id"]).count() == 0


def test_odd_elements_are_skipped(spark):
    good = '{"field_id": 15, "field_name": "Stage", "field_type": "select", "values": [{"value": "Lost"}]}'
    text = f'[1, "x", null, {{"field_id": 0, "field_name": "A"}}, {{"field_id": 3, "field_name": ""}}, {good}]'
    df = spark.createDataFrame([(1, 1, text)], "id long, updated_at long, custom_fields_values string")
    assert [(r.pos, r.field_id) for r in fields.fields_long(df, ["id"]).collect()] == [(0, "15")]


def test_same_fields_from_text_variant_and_typed_column(spark):
    text = HEAD % (7, "N", "numeric", '[{"value": "3"}]')
    as_text = spark.createDataFrame([(1, 1, text)], "id long, updated_at long, custom_fields_values string")
    as_variant = as_text.withColumn("custom_fields_values", F.parse_json("custom_fields_values"))
    in_variant_text = as_text.withColumn("custom_fields_values", F.col("custom_fields_values").cast("variant"))
    kind = "array<struct<field_id:bigint,field_name:string,field_type:string,values:array<struct<value:string>>>>"
    typed = as_text.withColumn("custom_fields_values", F.from_json("custom_fields_values", kind))
    seen = {
        str(layouts.sheet_table(df, fields.custom_columns(df)).first())
        for df in (as_text, as_variant, in_variant_text, typed)
    }
    assert seen == {"Row(N='3', id='1', updated_at='=DATE(1970;1;1) + TIME(0;0;1)')"}
