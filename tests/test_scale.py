"""Work that is done once: parsed lists, joined dictionaries, numbered documents, pages looked up, merged changes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import custom_fields as C
from entitylake.functions import variants as V
from entitylake.operators import fields
from entitylake.plans import exports, queries
from entitylake.plans import standins as S
from entitylake.session import scratch_dir
from entitylake.sources import history

FIELD = '{"field_id":1,"field_name":"A","field_type":"text","values":[{"value":"x"}]}'
DOCS = "id long, updated_at long, custom_fields_values string"


def docs(spark, rows=20):
    return spark.createDataFrame([(i, i, f"[{FIELD}]" if i % 3 else f"[1,{FIELD}]") for i in range(rows)], DOCS)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("headers_only", [True, False])
def test_a_list_is_parsed_once(spark, headers_only):
    plan = plan_of(fields.with_fields(docs(spark), headers_only=headers_only))
    assert plan.count("from_json(") == 1
    assert plan.count("parseJson") <= 2 and plan.count("parse_json") <= 2


def test_text_that_goes_on_is_no_json(spark):
    texts = ["1", ' {"a":[1]} ', "[1,2]", "", " ", "null", "1] ", "1],2", "1,2", '1,"v":2', '1,"a":2', "1}", "1}]", "]", "}", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_json(V.strict_json(F.col("t"))).alias("v")).collect()
    assert [r.v for r in got] == ["1", '{"a":[1]}', "[1,2]", None, None, "null", *[None] * 10]


def test_variant_lists_and_texts_of_lists(spark):
    texts = [f"[{FIELD}]", f"[7,{FIELD}]", '"[' + FIELD.replace('"', '\\"') + ']"', "5", "{}", '"x"', "null", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v"))
    got = df.select(F.size(C.custom_field_headers(F.col("v"), T.VariantType())).alias("n")).collect()
    assert [r.n for r in got] == [1, 1, 1, 0, 0, 0, 0, 0]


def test_long_form_is_not_shuffled_for_a_small_dictionary(spark):
    df = docs(spark)
    joined = fields.attach_types(fields.fields_long(df, ["id"]), fields.field_types(df))
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()
    assert {(r.field_name, r.field_type) for r in joined.collect()} == {("A", "text")} and joined.count() == 20


def test_documents_are_numbered_before_their_cells_are_made(spark, monkeypatch):
    seen = []

    def numbered(df, *args):
        seen.append(df.columns)
        return with_row_numbers(df, *args)

    with_row_numbers = exports.with_row_numbers
    monkeypatch.setattr(exports, "with_row_numbers", numbered)
    out = scratch_dir(spark, "sheets-test")
    assert exports.export_sheets(spark, {"deals": docs(spark)}, out, {"deals": "d"}).first()["rows"] == 20
    assert "custom_fields_values" in seen[0] and "cells" not in seen[0]
    rows = spark.read.parquet(f"{out}/deals/rows").orderBy("rn").collect()
    assert [r.rn for r in rows] == list(range(20)) and rows[3].cells[0] == "x" and rows[0].range == "Data!A2"
    # Columns of no type can't be written before they are cells.
    void = docs(spark).withColumn("nothing", F.lit(None))
    assert exports.export_sheets(spark, {"deals": void}, f"{out}/void", {"deals": "d"}).first()["rows"] == 20


def test_a_reader_reads_each_group_of_a_listing_once(spark, monkeypatch):
    monkeypatch.setattr(S, "ROW_GROUP_BYTES", 4096)
    rows = spark.range(5_000).selectExpr("id div 50 + 1 as page", "id", "'s' as status", "id * 10 as updated_at")
    path = scratch_dir(spark, "listing-test")
    S.write_listing(rows, path)
    listing = S.Listing(path)
    read = []
    for group in range(len(listing.groups)):
        part = listing.groups[group]
        listing.groups[group] = type("Counted", (), {"to_table": lambda _, p=part, g=group, **how: read.append(g) or p.to_table(**how)})()
    assert len(listing.groups) >= 4
    found = [r["id"] for page in range(1, 101) for r in listing.page(page)]
    assert found == list(range(5_000)) and len(read) <= 2 * len(listing.groups)
    fetch = S.listing_service(path)
    assert [r["id"] for r in fetch(1, 12_345, 12_400)] == list(range(1200, 1241)) and fetch(2, 49_991) == [] and len(fetch(100)) == 50
    assert fetch(101) == []


def test_merging_tasks_follow_the_number_of_changes(spark, monkeypatch):
    monkeypatch.setattr(history, "ROWS_PER_TASK", 10, raising=False)
    table = history.History(spark, scratch_dir(spark, "merged-test"), order_by=("at",))
    table.append(spark.range(200).selectExpr("id % 20 as id", "id as at", "if(id < 100, 'a', null) as status"))
    merged = table.merged()
    assert "RepartitionByExpression" in plan_of(merged) and ", 21" in plan_of(merged)
    assert {(r.id, r.at, r.status) for r in merged.collect()} == {(i, 180 + i, "a") for i in range(20)}


def test_stored_documents_are_grouped_once(spark, monkeypatch):
    names = []
    stored = queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, name: names.append(name) or stored(df, name))
    found = queries.stored_export(spark, "/root/testdata/sf0.001")
    assert names == ["current"] and "Aggregate" not in plan_of(found)
