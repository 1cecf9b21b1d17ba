"""What the physical plans must, and must not, contain."""

import pytest
from pyspark.sql import functions as F

from entitylake.operators import fields, layouts
from entitylake.operators import upsert as U
from entitylake.operators.partitioning import spread
from entitylake.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Plan nodes of row-wise Python and of joins over all pairs.
UNWANTED = ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_rows_and_no_pairs(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not [node for node in UNWANTED if node in text]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "deals")
    text = '[{"field_id": 1, "field_name": "F", "field_type": "text", "values": [{"value": "v"}]}]'
    spark.range(1000).select(
        "id", F.col("id").alias("updated_at"), F.lit("n").alias("name"), F.lit(text).alias("custom_fields_values")
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_wide_layouts_move_no_rows(stored):
    columns = fields.custom_columns(stored)
    for df in (layouts.workbook_table(stored, columns), layouts.sheet_table(stored, columns)):
        assert "Exchange" not in plan(df)


def test_unused_columns_are_not_read(stored):
    columns = fields.custom_columns(stored)
    assert "name" not in plan(layouts.workbook_table(stored, columns).select("custom_F_1")).split("ReadSchema")[1]
    types = plan(fields.field_types(stored))
    assert "name:string" not in types.split("ReadSchema")[1]
    assert "SortAggregate(key=[field_id" not in types.replace("field_types", "").split("partial_max(")[1]


def test_changes_are_reduced_before_they_move(stored):
    text = plan(U.latest_by_id(stored))
    assert "partial_max_by" in text and text.index("partial_max_by") > text.index("Exchange hashpartitioning(id")


def test_base_of_an_upsert_meets_small_changes_without_a_shuffle(stored, spark):
    changes = stored.limit(3)
    merged = U.upsert(stored, changes)
    merged.collect()
    assert "BroadcastHashJoin" in plan(merged) and "SortMergeJoin" not in plan(merged)


def test_spread_only_where_splits_are_few(spark, stored):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(0, 100, 1, 1)
    assert spread(one, "id").rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores)
    assert "Exchange" not in plan(spread(many, "id"))


def test_an_upsert_reads_each_side_once(spark):
    for name, scans in (("upsert_by_id", 3), ("replay_idempotent", 6)):
        assert plan(QUERIES[name](spark, SF_DIR)).count("FileScan") <= scans
