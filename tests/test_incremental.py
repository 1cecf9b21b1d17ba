"""Loads from the high-water mark, traces without repeats, and retention on disk."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from entitylake.operators import oplog, progress
from entitylake.sources.history import History
from entitylake.sources.snapshots import Snapshot
from entitylake.streaming import highwater, loads, traces


def deals(spark, rows):
    return spark.createDataFrame(rows, "id long, status string, updated_at long")


def test_changes_of_early_rows_are_seen(spark, tmp_path):
    table, marks = History(spark, f"{tmp_path}/t", order_by=("updated_at",)), highwater.HighWater(spark, f"{tmp_path}/m")
    assert marks.of("leads") is None
    assert highwater.load_changed(deals(spark, [(1, "a", 10), (2, "b", 20), (3, "c", None)]), table, marks, "leads") == 3
    assert marks.of("deals") == 20
    later = deals(spark, [(1, "changed", 30), (2, "b", 20), (3, "c", None), (4, "late", 15)])
    assert highwater.load_changed(later, table, marks, "leads") == 2  # the mark itself is read again
    assert highwater.load_changed(later, table, marks, "leads", overlap=15) == 3
    assert highwater.load_changed(deals(spark, []), table, marks, "leads") == 0
    assert marks.of("leads") == 30 and marks.of("contacts") is None
    assert sorted(map(tuple, table.current().collect())) == [(1, "changed", 30), (2, "b", 20), (3, "c", None), (4, "late", 15)]


def test_a_load_that_stops_before_its_mark_is_repeated(spark, tmp_path):
    table, marks = History(spark, f"{tmp_path}/t", order_by=("updated_at",)), highwater.HighWater(spark, f"{tmp_path}/m")
    source = deals(spark, [(1, "a", 10), (2, "b", 20)])
    table.append(source)  # the data was written, the mark was not
    assert highwater.load_changed(source, table, marks, "leads") == 2
    assert sorted(map(tuple, table.current().collect())) == [(1, "a", 10), (2, "b", 20)]


def test_the_range_reaches_the_scan(spark, tmp_path):
    deals(spark, [(1, "a", 10)]).write.parquet(f"{tmp_path}/source")
    source = spark.read.parquet(f"{tmp_path}/source").filter(F.col("updated_at") >= F.lit(5))
    assert "GreaterThanOrEqual(updated_at,5)" in source._jdf.queryExecution().executedPlan().toString()


def test_traces_are_left_once(spark, tmp_path):
    table = History(spark, f"{tmp_path}/t", order_by=("page", "pos"))
    row = lambda page, n: spark.createDataFrame([(page * 100 + i, page, i) for i in range(n)], "id long, page long, pos long")
    paths = f"{tmp_path}/progress", f"{tmp_path}/log"
    table.append(row(1, 50).union(row(2, 50)))
    loads.record_load(table, "leads", *paths)
    loads.record_load(table, "leads", *paths)
    assert spark.read.parquet(paths[1]).count() == 2
    reset = spark.createDataFrame([("deals", "reset")], "entity string, kind string").select(
        "entity", "kind", F.lit(None).cast("int").alias("page"), F.lit(False).alias("completed"), F.current_timestamp().alias("ts"), F.lit(0).cast("long").alias("seq")
    )
    progress.append_progress(reset, paths[0])
    loads.record_load(table, "leads", *paths)
    status = lambda: progress.export_status(spark.read.schema(progress.PROGRESS_SCHEMA).parquet(paths[0])).filter("entity = 'deals'").first()
    assert status().last_page == 0  # a call with nothing new leaves the reset as it is
    table.append(row(3, 7))
    loads.record_load(table, "leads", *paths)
    assert (status().last_page, status().completed) == (3, True)
    assert spark.read.parquet(paths[1]).count() == 3


def test_expired_days_are_gone(spark, tmp_path):
    path = f"{tmp_path}/log"
    times = ["2024-01-01 10:00:00", "2024-01-02 09:00:00", "2024-01-02 12:00:00", "2024-01-03 00:00:00"]
    entries = spark.createDataFrame([(t, str(i)) for i, t in enumerate(times)], "t string, message string")
    entries = entries.select(F.col("t").cast("timestamp").alias("timestamp"), F.lit("x").alias("component"), F.lit("info").alias("level"), "message", F.lit(None).cast("string").alias("details"))
    oplog.append_log(entries, path)
    left = lambda: sorted(r.message for r in spark.read.parquet(path).collect())
    days = lambda: sorted(d for d in os.listdir(path) if d.startswith("log_date"))
    untouched = os.listdir(f"{path}/log_date=2024-01-03")
    oplog.drop_expired(spark, path, datetime(2024, 1, 2, 12))
    assert left() == ["2", "3"] and days() == ["log_date=2024-01-02", "log_date=2024-01-03"]
    assert os.listdir(f"{path}/log_date=2024-01-03") == untouched
    oplog.drop_expired(spark, path, datetime(2024, 1, 2, 12))
    assert left() == ["2", "3"]
    oplog.drop_expired(spark, path, datetime(2024, 1, 2, 13))
    assert left() == ["3"] and days() == ["log_date=2024-01-03"]
    oplog.drop_expired(spark, path, datetime(2024, 1, 3))
    assert left() == ["3"]


def test_a_stored_table_is_replaced(spark, tmp_path):
    table = History(spark, f"{tmp_path}/t")
    table.append(deals(spark, [(1, "a", 10), (2, "b", 20)]))
    assert not table.replace(deals(spark, [])) and table.current().count() == 2
    assert table.replace(deals(spark, [(3, "c", 5)]))
    table._write(deals(spark, [(9, "stopped before its mark", 1)]), "unfinished")
    table.append(deals(spark, [(4, "d", 1)]))
    assert sorted(r.id for r in table.current().collect()) == [3, 4]
    assert table.replace(deals(spark, [(1, "a", 1), (1, "later", 2)]))
    assert [r.id for r in table.current().collect()] == [1]
    assert table.changes().count() == 2 + 1 + 1 + 1 + 2


def test_stored_fields_are_merged(spark, tmp_path):
    table = History(spark, f"{tmp_path}/t", order_by=("updated_at",))
    table.append(deals(spark, [(1, "a", 10), (2, "b", 20), (None, "x", 1)]))
    table.append(deals(spark, [(1, None, 30), (2, "c", 15), (None, "x", 1)]))
    found = sorted(map(tuple, table.merged().collect()), key=str)
    assert found == [(1, "a", 30), (2, "b", 20), (None, "x", 1)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_snapshot_equals_its_history(spark, tmp_path):
    table = History(spark, f"{tmp_path}/t", order_by=("updated_at",))
    snapshot = Snapshot(table, buckets=4, overlap=timedelta(0))
    table.append(deals(spark, [(i, "a", 10) for i in range(20)] + [(None, "x", 1), (None, "y", 1), (None, "x", 1)]))
    assert rows_of(snapshot.current()) == rows_of(table.current())  # nothing folded yet
    assert snapshot.fold() > 1 and snapshot.fold() == 0
    assert rows_of(snapshot.current()) == rows_of(table.current()) and table.current().count() == 22
    table.append(deals(spark, [(3, "new", 11), (4, "stale", 9), (30, "b", 1), (None, "x", 1), (None, "z", 1)]))
    assert rows_of(snapshot.current()) == rows_of(table.current())
    table.delete(spark.range(5, 7))
    assert rows_of(snapshot.current()) == rows_of(table.current()) and table.current().count() == 22
    snapshot.fold()
    table.append(spark.createDataFrame([(5, "back", 12, "extra")], "id long, status string, updated_at long, more string"))
    assert rows_of(snapshot.current()) == rows_of(table.current())
    assert snapshot.fold() >= 1  # rows that arrived at the mark itself are folded again
    assert rows_of(snapshot.current()) == rows_of(table.current())


def test_a_fold_touches_only_buckets_with_changes(spark, tmp_path):
    table = History(spark, f"{tmp_path}/t", order_by=("updated_at",))
    snapshot = Snapshot(table, buckets=8, overlap=timedelta(0))
    table.append(deals(spark, [(i, "a", 10) for i in range(100)]))
    assert snapshot.fold() == 8
    table.append(deals(spark, [(1, "b", 11)]))
    folders = lambda: {d: sorted(os.listdir(f"{tmp_path}/t/snapshot/{d}")) for d in os.listdir(f"{tmp_path}/t/snapshot") if "=" in d}
    before = folders()
    # The first batch arrived at the mark itself and is read again where times are equal.
    assert 1 <= snapshot.fold() <= 8
    assert before.keys() == folders().keys()


def test_a_fold_that_stops_and_a_replacement_lose_nothing(spark, tmp_path, monkeypatch):
    table = History(spark, f"{tmp_path}/t", order_by=("updated_at",))
    snapshot = Snapshot(table, buckets=4)
    table.append(deals(spark, [(1, "a", 10), (2, "b", 10)]))
    snapshot.fold()
    table.append(deals(spark, [(1, "c", 11)]))
    mark = Snapshot._mark
    with monkeypatch.context() as m:
        m.setattr(Snapshot, "_mark", lambda self, place, generation, upto: mark(self, place, generation, None))
        snapshot.fold()  # buckets were written, the last mark was not
    assert snapshot._upto() is None and rows_of(snapshot.current()) == [(1, "c", 11), (2, "b", 10)]
    snapshot.fold()
    assert snapshot._upto() is not None and rows_of(snapshot.current()) == [(1, "c", 11), (2, "b", 10)]
    table.replace(deals(spark, [(9, "only", 1)]))
    assert rows_of(snapshot.current()) == [(9, "only", 1)]
    snapshot.fold()
    assert rows_of(snapshot.current()) == [(9, "only", 1)] and snapshot._upto() is not None


def test_a_read_moves_no_row_of_the_snapshot(spark, tmp_path):
    table = History(spark, f"{tmp_path}/t", order_by=("updated_at",))
    snapshot = Snapshot(table, buckets=4, overlap=timedelta(0))
    table.append(spark.range(1000).select("id", F.lit("a").alias("status"), F.lit(1).cast("long").alias("updated_at")))
    snapshot.fold()
    table.append(deals(spark, [(1, "b", 2)]))
    read = snapshot.current()
    assert read.count() == 1000
    read.collect()
    final = read._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and "LeftAnti" in final
    assert "SortMergeJoin" not in final.split("LeftAnti")[0].split("Union")[-1]


def test_events_of_running_loads(spark, tmp_path):
    def page(number, size):
        leads = [{"id": number * 100 + i} for i in range(size)]
        return json.dumps({"_page": number, "_embedded": {"leads": leads}})

    def land(name, *pages):
        os.makedirs(f"{tmp_path}/landing", exist_ok=True)
        with open(f"{tmp_path}/landing/{name}", "w") as f:
            f.write("\n".join(pages))

    to_rows = lambda docs: docs.select(F.expr("try_variant_get(doc, '$.id', 'bigint')").alias("id"), "page", "pos")
    table = History(spark, f"{tmp_path}/t", order_by=("page", "pos"))
    events = lambda: sorted(map(tuple, traces.load_events(spark, f"{tmp_path}/events").select("entity", "page", "completed", "documents").collect()))
    with traces.traced(spark, f"{tmp_path}/events") as told:
        load = lambda: told.wait(loads.load_pages(spark, f"{tmp_path}/landing", "leads", table, f"{tmp_path}/checkpoint", to_rows))
        land("a.json", page(1, 50), page(2, 50))
        load()
        assert events() == [("deals", 2, False, 100)]
        load()  # nothing new
        assert events() == [("deals", 2, False, 100)]
        land("b.json", page(3, 7))
        load()
        assert events() == [("deals", 2, False, 100), ("deals", 3, True, 7)]
        assert sorted(r.message for r in traces.log_entries(traces.load_events(spark, f"{tmp_path}/events")).collect())[-1] == "Loaded 7 deals up to page 3"
