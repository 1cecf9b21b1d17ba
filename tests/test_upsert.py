"""Keyed changes: rules, idempotence, independence of partitioning."""

import pytest
from pyspark.sql import functions as F

from entitylake.operators import upsert as U
from entitylake.sources.history import ARRIVED, History

SCHEMA = "id long, a string, seq long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def base(spark):
    return spark.createDataFrame([(1, "x", 0), (2, "y", 0), (None, "keyless", 0)], SCHEMA)


def test_last_change_of_an_id_wins(spark):
    empty = spark.createDataFrame([], SCHEMA)
    changes = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], SCHEMA)
    assert rows(U.upsert(empty, changes, order_by=("seq",))) == [(1, "b", 2)]


def test_upsert_twice_is_upsert_once(spark, base):
    changes = spark.createDataFrame([(2, "z", 1), (3, "n", 1), (None, "p", 1), (None, "p", 2)], SCHEMA)
    once = U.upsert(base, changes, order_by=("seq",))
    twice = U.upsert(once, changes, order_by=("seq",))
    assert rows(once) == rows(twice)
    assert [r for r in rows(once) if r[0] is None] == [(None, "keyless", 0), (None, "p", 1), (None, "p", 2)]


def test_upsert_of_nothing(spark, base):
    assert rows(U.upsert(base, base.limit(0), order_by=("seq",))) == rows(base)


def test_ties_do_not_depend_on_partitioning(spark):
    changes = spark.range(2000).select((F.col("id") % 7).alias("id"), F.col("id").cast("string").alias("a"), F.lit(1).alias("seq"))
    results = {str(rows(U.latest_by_id(changes.repartition(n), order_by=("seq",)))) for n in (1, 3, 8)}
    assert len(results) == 1


def test_change_wins_over_newer_stored_row_unless_newest_is_asked(spark):
    stored = spark.createDataFrame([(1, "stored", 9)], SCHEMA)
    late = spark.createDataFrame([(1, "late", 3), (2, "new", 1)], SCHEMA)
    assert rows(U.upsert(stored, late, order_by=("seq",))) == [(1, "late", 3), (2, "new", 1)]
    assert rows(U.upsert_newest(stored, late, order_by=("seq",))) == [(1, "stored", 9), (2, "new", 1)]


def test_null_order_is_lowest(spark):
    changes = spark.createDataFrame([(1, "none", None), (1, "some", 1)], SCHEMA)
    assert rows(U.latest_by_id(changes, order_by=("seq",))) == [(1, "some", 1)]


def test_outcomes(spark, base):
    ids = spark.createDataFrame([(1,), (1,), (7,), (None,)], "id long")
    assert rows(U.upsert_outcome(base, ids)) == [(1, "updated"), (7, "added")]
    assert rows(U.delete_outcome(base, ids)) == [(1, True), (7, False)]


def test_delete(spark, base):
    ids = spark.createDataFrame([(1,), (7,), (None,)], "id long")
    assert rows(U.delete_by_id(base, ids)) == [(2, "y", 0), (None, "keyless", 0)]


def test_replace_all_keeps_on_empty(spark, base):
    assert rows(U.replace_all(base, base.limit(0))) == rows(base)
    assert rows(U.replace_all(base, base.filter("id = 1"))) == [(1, "x", 0)]


def test_merge_overwrites_only_carried_fields(spark):
    base = spark.createDataFrame([(1, "a0", "b0"), (9, "a9", "b9"), (None, "k", "k")], "id long, a string, b string")
    changes = spark.createDataFrame(
        [(1, None, "b1", 1, False), (1, "a2", None, 2, True), (1, None, None, 3, True), (2, None, "b", 1, False), (None, "k", "k", 1, True)],
        "id long, a string, b string, seq long, has_a boolean",
    )
    merged = U.merge_fields(base, changes, order_by=("seq",))
    assert rows(merged) == [(1, "a2", "b1"), (2, None, "b"), (9, "a9", "b9"), (None, "k", "k")]
    explicit = U.merge_fields(base, changes, order_by=("seq",), present={"a": "has_a"})
    assert rows(explicit)[0] == (1, None, "b1")


def test_merge_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", None)], "id long, a string, b string")
    changes = spark.createDataFrame([(1, None, "b", 1)], "id long, a string, b string, seq long")
    once = U.merge_fields(base, changes, order_by=("seq",))
    assert rows(once) == rows(U.merge_fields(once, changes, order_by=("seq",))) == [(1, "a", "b")]


# -- stored tables -----------------------------------------------------------------------

def change(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_table_life(spark, tmp_path):
    table = History(spark, str(tmp_path / "t"), order_by=[ARRIVED, "seq"])
    with pytest.raises(LookupError):
        table.current()
    table.append(change(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "k", 1)))
    table.append(change(spark).limit(0))
    table.append(change(spark, (2, "d", 1), (3, "e", 1), (None, "k", 1)))
    assert rows(table.current()) == [(1, "b", 2), (2, "d", 1), (3, "e", 1), (None, "k", 1)]
    table.delete(spark.createDataFrame([(1,), (44,), (None,)], "id long"))
    assert rows(table.current()) == [(2, "d", 1), (3, "e", 1), (None, "k", 1)]
    table.append(change(spark, (1, "back", 1)))
    before = rows(table.current())
    assert (1, "back", 1) in before
    compacted = table.compact(str(tmp_path / "compacted"))
    assert rows(compacted.current()) == before and compacted.changes().count() == len(before)


def test_ordered_table_takes_late_batches(spark, tmp_path):
    table = History(spark, str(tmp_path / "t"), order_by=["seq"])
    table.append(change(spark, (1, "new", 9), (2, "two", 1)))
    table.append(change(spark, (1, "late", 3)))
    assert rows(table.current()) == [(1, "new", 9), (2, "two", 1)]
    table.delete(spark.createDataFrame([(1,)], "id long"))
    assert rows(table.current()) == [(2, "two", 1)]
    table.append(change(spark, (1, "again", 2)))
    assert rows(table.current()) == [(1, "again", 2), (2, "two", 1)]


def test_new_columns_and_text_ids(spark, tmp_path):
    table = History(spark, str(tmp_path / "t"), order_by=["seq"])
    table.append(spark.createDataFrame([("x", "a", 1), ("2", "b", 1)], "id string, a string, seq long"))
    table.append(spark.createDataFrame([("2", "w", 6, True)], "id string, a string, seq long, extra boolean"))
    assert {(r.id, r.extra) for r in table.current().collect()} == {("x", None), ("2", True)}
    table.delete(spark.createDataFrame([("x",)], "id string"))
    assert [r.id for r in table.current().collect()] == ["2"]


def test_merge_on_an_empty_base_and_of_ties(spark):
    schema = "id long, a string, b string, seq long"
    changes = [(1, "a", None, 1), (1, None, "b", 2), (2, "v0", None, 5), (2, "v7", None, 5), (None, "k", None, 1)]
    empty = spark.createDataFrame([], schema)
    results = [rows(U.merge_fields(empty, spark.createDataFrame(order, schema))) for order in (changes, changes[::-1])]
    assert results[0] == results[1] and results[0][0] == (1, "a", "b", 2) and len(results[0]) == 3
