"""Filters, log, progress, counts, delivery, exports."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from entitylake.operators import delivery, filters, oplog, pages, progress, stats
from entitylake.plans import exports
from entitylake.specs import canonical, canonical_name

UTC = timezone.utc


def epoch(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp())


# -- filters -----------------------------------------------------------------------------

def test_range_is_inclusive_and_ends_at_midnight(spark):
    times = [epoch(2023, 12, 31, 23, 59, 59), epoch(2024, 1, 1), epoch(2024, 1, 2), epoch(2024, 1, 2, 0, 0, 1), None]
    df = spark.createDataFrame([(t,) for t in times], "updated_at long")
    chosen = filters.updated_range(df, "2024-01-01", "2024-01-02")
    assert sorted(r.updated_at for r in chosen.collect()) == times[1:3]
    moments = df.select(F.timestamp_seconds("updated_at").cast("timestamp_ntz").alias("updated_at"))
    assert filters.updated_range(moments, "2024-01-01", "2024-01-02").count() == 2
    assert filters.updated_range(df, date_to="2024-01-01").count() == 2
    assert filters.updated_range(df).count() == 5


def test_range_never_matches_text(spark):
    df = spark.createDataFrame([("5",), ('"5"',), ("5.0",), ("true",), ("null",)], "t string").select(
        "t", F.parse_json("t").alias("updated_at")
    )
    chosen = filters.updated_range(df, "1970-01-01", "1970-01-02")
    assert sorted(r.t for r in chosen.collect()) == ["5", "5.0"]
    assert filters.updated_range(df.select(F.col("t").alias("updated_at")), "1970-01-01").count() == 0


def test_bad_date_is_rejected(spark):
    with pytest.raises(ValueError):
        filters.updated_range(spark.range(1).withColumnRenamed("id", "updated_at"), "yesterday")


def test_range_and_lookup_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.col("id").alias("updated_at"), F.lit("x").alias("other")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = filters.updated_range(df, "1970-01-01", "1970-01-02").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(updated_at,0)" in plan and "LessThanOrEqual(updated_at,86400)" in plan
    assert "other" not in plan.split("ReadSchema")[1]
    assert "EqualTo(id,7)" in filters.point_lookup(df, 7)._jdf.queryExecution().executedPlan().toString()


def test_aliases(spark):
    names = ["leads", "deals", "contacts", "odd"]
    df = spark.createDataFrame([(n,) for n in names], "e string").select("e", canonical(F.col("e")).alias("c"))
    assert {r.e: r.c for r in df.collect()} == {n: canonical_name(n) for n in names}
    assert canonical_name("leads") == "deals" and canonical_name("odd") == "odd"


# -- pages -------------------------------------------------------------------------------

def test_full_page_means_more(spark):
    sizes = spark.createDataFrame([("deals", 1, 50), ("deals", 2, 50), ("deals", 4, 49)], "entity string, page long, n_rows long")
    audit = {r.page: (r.has_more, r.next_page, r.gap_after) for r in pages.page_audit(sizes).collect()}
    assert audit == {1: (True, 2, False), 2: (True, 4, True), 4: (False, None, False)}
    assert tuple(pages.progress_of_pages(sizes).first()) == ("deals", 4, True)


def test_pages_over_range_borders(spark):
    sizes = spark.createDataFrame([("e", p, 50) for p in (9_999, 10_000, 25_000)], "entity string, page long, n_rows long")
    assert {r.page: r.next_page for r in pages.page_audit(sizes).collect()} == {9_999: 10_000, 10_000: 25_000, 25_000: None}


def test_envelopes_without_rows(spark):
    texts = ['{"_embedded": {"leads": [{"id": 1}, {"id": 2}]}}', '{"_embedded": {"leads": []}}', '{"_embedded": {}}', "{}", "junk"]
    df = spark.createDataFrame(list(enumerate(texts)), "page int, t string").select("page", F.try_parse_json("t").alias("envelope"))
    assert [(r.page, r.pos) for r in pages.explode_envelopes(df, "deals").collect()] == [(0, 0), (0, 1)]
    assert [r.n_rows for r in pages.envelope_sizes(df, "leads").orderBy("page").collect()] == [2, 0, 0, 0, 0]


# -- log -------------------------------------------------------------------------------------

@pytest.fixture
def logs(spark):
    start = datetime(2024, 1, 1, tzinfo=UTC)
    data = [
        (start.replace(day=d), "api", level, message, None)
        for d, level, message in [(1, "info", "Fetched Leads"), (2, "error", "leads failed"), (3, "error", "LEADS (x) again"), (4, "error", "other")]
    ]
    return spark.createDataFrame(data, oplog.LOG_SCHEMA)


def test_recent_logs(logs):
    def days(**how):
        return [r.d for r in oplog.recent_logs(logs, **how).select(F.dayofmonth("timestamp").alias("d")).collect()]

    assert days(count=2) == [4, 3]
    assert days(count=0) == [4, 3, 2, 1]
    assert days(level="error", message="leads", count=2) == [3, 2]
    assert days(message="leads .*again") == [3]
    assert days(message="(x)", literal=True) == [3]
    assert days(level="Error") == []


def test_recent_logs_is_a_top_k(logs):
    assert "TakeOrderedAndProject" in oplog.recent_logs(logs, 2)._jdf.queryExecution().executedPlan().toString()


def test_log_round_trip_and_retention(spark, logs, tmp_path):
    path = f"{tmp_path}/log"
    oplog.append_log(logs, path)
    oplog.append_log(logs.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp")), path)
    stored = spark.read.parquet(path)
    assert stored.filter("timestamp is null").isEmpty() and stored.count() == 5
    kept = oplog.retained(stored, oplog.cutoff(datetime(2024, 1, 10), 7))
    assert kept.count() == 3
    assert "PartitionFilters: [isnotnull(log_date" in kept._jdf.queryExecution().executedPlan().toString()


# -- progress ---------------------------------------------------------------------------------

def events(spark, *data):
    rows = [(e, k, p, c, datetime(2024, 1, 1, 0, 0, i, tzinfo=UTC), i) for i, (e, k, p, c) in enumerate(data)]
    return spark.createDataFrame(rows, progress.PROGRESS_SCHEMA)


def status(spark, *data):
    return {r.entity: (r.running, r.completed, r.last_page) for r in progress.export_status(events(spark, *data)).collect()}


def test_status_of_nothing(spark):
    assert status(spark) == {e: (False, False, 0) for e in ("deals", "contacts", "companies", "events")}


def test_progress_reset_and_runs(spark):
    seen = status(
        spark,
        ("leads", "started", None, None),
        ("leads", "progress", 3, False),
        ("deals", "progress", 4, True),
        ("contacts", "progress", 9, True),
        ("contacts", "reset", None, None),
        ("odd", "started", None, None),
        ("odd", "progress", 1, False),
    )
    assert seen["deals"] == (True, True, 4) and seen["contacts"] == (False, False, 0) and seen["odd"] == (True, False, 1)


def test_clear_and_reset_all(spark):
    started = [("deals", "started", None, None), ("deals", "progress", 4, True)]
    assert status(spark, *started, (None, "clear_running", None, None))["deals"] == (False, True, 4)
    assert status(spark, *started, (None, "reset_all", None, None))["deals"] == (False, False, 0)
    assert status(spark, (None, "reset_all", None, None), *started)["deals"] == (True, True, 4)


def test_resume_and_verify(spark):
    log = events(spark, ("deals", "progress", 4, False), ("deals", "started", None, None), ("ghost", "started", None, None))
    state = progress.export_status(log)
    assert {r.entity: r.next_page for r in progress.resume_points(state).collect()}["deals"] == 5
    assert progress.last_page(state, "deals") == 4 and progress.last_page(state, "nobody") == 0
    verified = progress.verify_running(log, spark.createDataFrame([("leads",)], "entity string"))
    assert {r.entity: r.valid for r in verified.collect()} == {"deals": True, "ghost": False}
    assert [r.entity for r in progress.stop_events(verified).collect()] == ["ghost"]


def test_progress_survives_storage(spark, tmp_path):
    log = events(spark, ("deals", "progress", 4, False), ("deals", "progress", 5, True))
    progress.append_progress(log.limit(1), f"{tmp_path}/p")
    progress.append_progress(log.filter("page = 5"), f"{tmp_path}/p")
    assert progress.last_page(progress.export_status(spark.read.parquet(f"{tmp_path}/p")), "deals") == 5


# -- counts and delivery -------------------------------------------------------------------------

def test_counts_fill_zeros_and_merge_aliases(spark):
    counts = stats.entity_counts({"leads": spark.range(2), "deals": spark.range(3), "events": spark.range(0)}, with_logs=True)
    assert {r.entity: r.n for r in counts.collect()} == {"deals": 5, "contacts": 0, "companies": 0, "events": 0, "logs": 0}


def test_webhook_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "event_type string")
    assert {tuple(r) for r in stats.webhook_counts(df).collect()} == {("a", 2, False), (None, 1, False), (None, 3, True)}


def test_placeholders_and_targets(spark):
    assert {r.entity for r in delivery.empty_placeholders({"leads": spark.range(1), "events": spark.range(0)}).collect()} == {
        "contacts",
        "companies",
        "events",
    }
    assert delivery.missing_targets({"leads": "x", "contacts": ""}) == ["contacts", "companies", "events"]
    df = spark.createDataFrame([("leads",), ("events",)], "entity string")
    assert {tuple(r) for r in delivery.with_target(df, {"deals": "x"}).collect()} == {("deals", "x"), ("events", None)}


def test_exports_isolate_failures(spark, tmp_path):
    good = spark.createDataFrame([(1, 5, "n", None)], "id long, updated_at long, name string, custom_fields_values string")
    broken = good.withColumn("name", F.expr("assert_true(false, 'broken row')"))
    frames = {"deals": good, "contacts": broken, "companies": good.limit(0)}
    report = exports.export_workbook(spark, frames, f"{tmp_path}/book", fmt="json")
    seen = {r.entity: (r.status, r.rows) for r in report.collect()}
    assert seen == {"deals": ("written", 1), "contacts": ("failed", 0), "companies": ("empty", 0)}
    assert spark.read.json(f"{tmp_path}/book/companies").first().Info == "No companies data available"
    assert "broken row" in spark.read.json(f"{tmp_path}/book/contacts_error").first().Error
    exports.export_workbook(spark, {}, f"{tmp_path}/none", fmt="csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/none/Summary").count() == 2


def test_sheet_export(spark, tmp_path):
    df = spark.createDataFrame([(i, i, f"+{i}") for i in range(3)] + [(None, 7, "k")], "id long, updated_at long, name string")
    report = exports.export_sheets(spark, {"deals": df, "events": df}, f"{tmp_path}/s", {"leads": "x"})
    assert {(r.entity, r.status, r.rows) for r in report.collect()} == {("deals", "written", 4), ("events", "failed", 0)}
    assert spark.read.json(f"{tmp_path}/s/deals/header").first().headers == ["id", "name", "updated_at"]
    stored = spark.read.parquet(f"{tmp_path}/s/deals/rows").collect()
    assert sorted(r.rn for r in stored) == [0, 1, 2, 3] and {r.range for r in stored} == {"Data!A2"}
    assert ["1", "'+1", "=DATE(1970;1;1) + TIME(0;0;1)"] in [r.cells for r in stored]


def test_aliases_and_unknown_entities_need_a_target(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "n")], "id long, updated_at long, name string")
    report = exports.export_sheets(spark, {"leads": df, "tasks": df}, f"{tmp_path}/s", {"contacts": "x", "companies": ""})
    assert {(r.entity, r.status) for r in report.collect()} == {("deals", "failed"), ("tasks", "failed")}
    report = exports.export_sheets(spark, {"leads": df}, f"{tmp_path}/t", {"deals": "x"})
    assert [(r.entity, r.status) for r in report.collect()] == [("deals", "written")]


def test_status_of_all_entities_needs_no_single_task(spark):
    rows = [("deals", "started", None, None, datetime(2024, 1, 1), 1), (None, "clear_running", None, None, datetime(2024, 1, 2), 2)]
    rows += [("contacts", "started", None, None, datetime(2024, 1, 3), 3)]
    status = progress.export_status(spark.createDataFrame(rows, progress.PROGRESS_SCHEMA))
    assert {r.entity: r.running for r in status.collect()} == {"deals": False, "contacts": True, "companies": False, "events": False}
    assert "SinglePartition" not in status._jdf.queryExecution().executedPlan().toString()
