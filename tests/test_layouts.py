"""Layouts: names, collisions, types, headers, documents."""

import pytest
from pyspark.sql import functions as F

from entitylake.operators import chunks, documents, fields, layouts

SCHEMA = "id long, name string, updated_at long, custom_fields_values string"


def one(field_id, name, kind, value):
    return (
        f'{{"field_id": {field_id}, "field_name": "{name}", "field_type": "{kind}", "values": [{{"value": "{value}"}}]}}'
    )


@pytest.fixture(scope="module")
def stages(spark):
    text = f"[{one(10, 'Stage', 'select', 'Won')}, {one(15, 'Stage', 'select', 'Lost')}, {one(16, 'name', 'text', 'B')}]"
    return spark.createDataFrame([(1, "A", 5, text), (2, "C", 6, None)], SCHEMA)


def test_two_ids_with_one_name(stages):
    columns = fields.custom_columns(stages)
    book = layouts.workbook_table(stages, columns).orderBy("id").collect()
    assert (book[0]["custom_Stage_10"], book[0]["custom_Stage_15"], book[1]["custom_Stage_15"]) == ("Won", "Lost", None)
    sheet = layouts.sheet_table(stages, columns).orderBy("id").collect()
    assert (sheet[0]["Stage"], sheet[1]["Stage"]) == ("Lost", "")


def test_custom_name_overrides_base_name(stages):
    columns = fields.custom_columns(stages)
    assert [r["name"] for r in layouts.sheet_table(stages, columns).orderBy("id").collect()] == ["B", "C"]
    assert layouts.workbook_table(stages, columns).orderBy("id").first()["name"] == "A"


def test_later_duplicate_of_a_field_wins(spark):
    text = f"[{one(1, 'F', 'text', 'first')}, {one(2, 'G', 'text', 'g')}, {one(1, 'F', 'text', 'last')}]"
    df = spark.createDataFrame([(1, "A", 5, text)], SCHEMA)
    assert layouts.workbook_table(df, fields.custom_columns(df)).first()["custom_F_1"] == "last"
    long = fields.fields_long(df, ["id"]).orderBy("pos").collect()
    assert [(r.field_id, r.pos) for r in long] == [("2", 0), ("1", 1)]


def test_type_is_the_last_seen_of_the_dataset(spark):
    rows = [
        (1, "A", 20, f"[{one(1, 'F', 'numeric', '7.0')}]"),
        (2, "B", 10, f"[{one(1, 'F', 'text', '8.0')}]"),
        (3, "C", None, f"[{one(1, 'F', 'date', '9.0')}]"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert fields.custom_columns(df) == [fields.CustomColumn("1", "F", "numeric")]
    sheet = layouts.sheet_table(df, fields.custom_columns(df)).orderBy("id")
    assert [r["F"] for r in sheet.collect()] == ["7", "8", "9"]


def test_same_name_under_two_types(spark):
    rows = [(1, "A", 1, f"[{one(1, 'F', 'numeric', '7.0')}]"), (2, "B", 2, f"[{one(2, 'F', 'text', '7.0')}]")]
    df = spark.createDataFrame(rows, SCHEMA)
    sheet = layouts.sheet_table(df, fields.custom_columns(df)).orderBy("id")
    assert [r["F"] for r in sheet.collect()] == ["7", "7.0"]


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1, "A", 1, f"[{one(1, 'Sum, net. `x`', 'text', 'v')}]")], SCHEMA)
    columns = fields.custom_columns(df)
    assert layouts.workbook_table(df, columns).first()["custom_Sum, net. `x`_1"] == "v"
    assert layouts.sheet_table(df, columns).first()["Sum, net. `x`"] == "v"


def test_names_differing_in_case_are_different_columns(spark):
    df = spark.createDataFrame([(1, "A", 1, f"[{one(1, 'Name', 'text', 'custom')}]")], SCHEMA)
    row = layouts.sheet_table(df, fields.custom_columns(df)).first()
    assert (row["name"], row["Name"]) == ("A", "custom")


def test_typed_workbook(spark):
    text = f"[{one(1, 'N', 'numeric', '7.5')}, {one(2, 'D', 'date', '2024-1-2')}, {one(3, 'T', 'datetime', '60')}]"
    df = spark.createDataFrame([(1, "A", 1, text)], SCHEMA)
    wide = layouts.workbook_table(df, fields.custom_columns(df), typed=True)
    kinds = dict(wide.dtypes)
    assert [kinds[c] for c in ("custom_N_1", "custom_D_2", "custom_T_3")] == ["double", "date", "timestamp"]
    row = wide.select("custom_N_1", F.col("custom_D_2").cast("string"), F.unix_seconds("custom_T_3")).first()
    assert tuple(row) == (7.5, "2024-01-02", 60)


def test_long_and_wide_agree(spark, stages):
    columns = fields.custom_columns(stages)
    wide = layouts.workbook_table(stages, columns).collect()
    from_wide = {(r["id"], c.field_id, r[c.workbook_name]) for r in wide for c in columns if r[c.workbook_name] is not None}
    long = layouts.custom_values(stages, fields.field_types(stages), ["id"])
    assert from_wide == {(r.id, r.field_id, r.workbook_value) for r in long.collect()}


def test_dictionary_is_joined_without_a_hint(stages, spark):
    long = fields.fields_long(stages, ["id"])
    typed = fields.attach_types(long, fields.field_types(stages))
    assert "ResolvedHint" not in typed._jdf.queryExecution().analyzed().toString()
    assert len(typed.collect()) == 3


def test_columns_of_whole_documents_with_odd_ids(spark):
    field = '[{"field_id": 1, "field_name": "F", "field_type": "%s", "values": [{"value": "v"}]}]'
    docs = [
        '{"id": 5, "updated_at": 7, "custom_fields_values": %s}' % (field % "text"),
        '{"id": "x", "updated_at": 9, "custom_fields_values": %s}' % (field % "url"),
        '{"id": null, "custom_fields_values": %s}' % (field % "date"),
    ]
    df = spark.createDataFrame([(d,) for d in docs], "t string").select(F.parse_json("t").alias("doc"))
    whole = documents.expand_documents(df, documents.header_union(df))
    assert [c.field_type for c in fields.custom_columns(whole)] == ["url"]
    assert layouts.workbook_table(whole, fields.custom_columns(whole)).count() == 3
    bare = whole.drop("updated_at")
    assert len(fields.custom_columns(bare)) == 1 and layouts.sheet_table(bare, fields.custom_columns(bare)).count() == 3


@pytest.mark.parametrize("text", ['[{"field_id": 1, "field_name": "F", "values": []}] junk ]', "[1] [2]", "{}", "nul"])
def test_text_that_is_no_json_has_no_fields(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, custom_fields_values string")
    assert fields.fields_long(df, ["id"]).count() == 0


def test_documents_by_layout(spark):
    texts = ['{"b": 1, "a": {"x": 1}}', "{}", None, '{"é": "+1", "b": null}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.try_parse_json("t").alias("doc"))
    keys = documents.header_union(df)
    assert keys == ["a", "b", "é"]
    assert documents.expand_documents(df, keys).count() == 2
    assert documents.expand_documents(df, keys, keep_empty=True).count() == 4
    sheet = layouts.sheet_table(documents.expand_documents(df, keys), [])
    assert {tuple(r) for r in sheet.collect()} == {('{"x":1}', "1", ""), ("", "", "'+1")}


def test_whole_document_frame_through_both_layouts(spark):
    doc = (
        '{"id": 1, "updated_at": 1700000000, "tags": [], "_links": {"self": {"href": "u"}}, '
        f'"custom_fields_values": [{one(10, "Stage", "select", "Won")}]}}'
    )
    df = spark.createDataFrame([(doc,)], "t string").select(F.parse_json("t").alias("doc"))
    wide = documents.expand_documents(df, documents.header_union(df))
    typed = wide.withColumn("id", F.col("id").cast("bigint")).withColumn("updated_at", F.col("updated_at").cast("bigint"))
    columns = fields.custom_columns(typed)
    assert layouts.sheet_table(wide, columns).first().asDict() == {
        "Stage": "Won",
        "id": "1",
        "link_url": "u",
        "tags": "",
        "updated_at": "=DATE(2023;11;14) + TIME(22;13;20)",
    }
    assert layouts.workbook_table(wide, columns).first()["link_url"] == "u"


def test_expand_relations_keeps_rows_without_any(spark):
    df = spark.createDataFrame([(1, '[{"id": 5}, {"id": 6}]'), (2, "[]"), (3, None)], "id long, leads string")
    rows = documents.expand_relations(df, "leads").select("id", "pos").collect()
    assert {tuple(r) for r in rows} == {(1, 0), (1, 1), (2, None), (3, None)}


# -- chunks ---------------------------------------------------------------------------

@pytest.mark.parametrize("per_slice", [7, 100, 10_000])
def test_row_numbers_are_dense_and_ordered(spark, per_slice):
    ids = spark.range(0, 3000, 3).unionByName(spark.range(1_000_000, 1_002_000)).repartition(5)
    rows = chunks.with_row_numbers(ids, "id", per_slice).orderBy("id").collect()
    assert [r.rn for r in rows] == list(range(3000))


def test_chunk_starts(spark):
    placed = chunks.with_chunks(spark.range(5001).withColumnRenamed("id", "rn"))
    starts = {(r.chunk, r.range): r["count"] for r in placed.groupBy("chunk", "range").count().collect()}
    assert starts == {(0, "Data!A2"): 5000, (1, "Data!A5002"): 1}
    assert chunks.chunk_plan(5001) == [(0, "Data!A2", 5000), (1, "Data!A5002", 1)]
    assert chunks.chunk_plan(0) == []
