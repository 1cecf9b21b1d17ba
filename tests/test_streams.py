"""Streaming loads: same as batch, resumable, replayable, isolated."""

import json
import os

import pytest
from pyspark.sql import functions as F

from entitylake.functions import variants as V
from entitylake.sources import landing
from entitylake.operators.filters import updated_range
from entitylake.sources.paged import paged_source, read_paged, stream_paged
from entitylake.sources.history import History
from entitylake.streaming import loads


def land(folder, page, documents):
    os.makedirs(folder / f"page={page}", exist_ok=True)
    (folder / f"page={page}" / "x.json").write_text(json.dumps({"_embedded": {"leads": documents}}))


def to_rows(batch):
    return batch.select(
        V.at(F.col("doc"), "$.id", "bigint").alias("id"), V.at(F.col("doc"), "$.v", "string").alias("v"), "page", "pos"
    )


def state(table):
    return sorted((r.id, r.v) for r in table.current().collect())


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "landing"
    for page in range(1, 6):
        land(folder, page, [{"id": page * 10 + i, "v": f"p{page}"} for i in range(3)] + [{"id": 1, "v": f"p{page}"}])
    return folder


def load(spark, pages, tmp_path, per_batch, name):
    table = History(spark, f"{tmp_path}/{name}", order_by=["page", "pos"])
    loads.load_pages(
        spark, str(pages), "deals", table, f"{tmp_path}/{name}-checkpoint", to_rows, pages_per_batch=per_batch
    ).awaitTermination()
    return table


def test_result_does_not_depend_on_batch_size(spark, pages, tmp_path):
    results = [state(load(spark, pages, tmp_path, n, f"t{n}")) for n in (1, 2, 100)]
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 16 and results[0][0] == (1, "p5")


def test_resume_takes_only_new_pages_and_replay_changes_nothing(spark, pages, tmp_path):
    table = load(spark, pages, tmp_path, 2, "t")
    arrived = table.changes().count()
    load(spark, pages, tmp_path, 2, "t")
    assert table.changes().count() == arrived
    land(pages, 6, [{"id": 60, "v": "p6"}])
    load(spark, pages, tmp_path, 2, "t")
    assert table.changes().count() == arrived + 1 and (60, "p6") in state(table)
    before = state(table)
    loads.load_pages(spark, str(pages), "deals", table, f"{tmp_path}/fresh", to_rows).awaitTermination()
    assert state(table) == before and table.changes().count() == 2 * (arrived + 1)


def test_load_of_a_date_range(spark, tmp_path):
    stamps = {1: 100, 2: 86_400, 3: "90000", 4: None, 5: 172_800.5, 6: 400_000}
    land(tmp_path / "in", 1, [{"id": i, "v": "x", "updated_at": t} for i, t in stamps.items()])
    table = History(spark, f"{tmp_path}/t", order_by=["page", "pos"])
    loads.load_pages(
        spark, f"{tmp_path}/in", "deals", table, f"{tmp_path}/c", to_rows, date_from="1970-01-02", date_to="1970-01-03T23:00:00"
    ).awaitTermination()
    assert [i for i, _ in state(table)] == [2, 5]


def test_bad_pages_land_in_quarantine(spark, pages, tmp_path):
    (pages / "page=2" / "bad.json").write_text("not json\n")
    (pages / "page=3" / "bad.json").write_text('{"_embedded": {}} trailing\n')
    table = load(spark, pages, tmp_path, 2, "t")
    for _ in range(2):
        loads.quarantine_pages(spark, str(pages), "leads", f"{tmp_path}/bad", f"{tmp_path}/bad-c").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/bad").collect()
    assert sorted(r.raw for r in kept) == ["not json", '{"_embedded": {}} trailing'] and {r.entity for r in kept} == {"deals"}
    assert len(state(table)) == 16


def test_one_failing_entity_leaves_the_others(spark, pages, tmp_path):
    def start(entity, rows):
        table = History(spark, f"{tmp_path}/{entity}", order_by=["page", "pos"])
        return lambda: loads.load_pages(spark, str(pages), entity, table, f"{tmp_path}/{entity}-c", rows)

    def broken(batch):
        raise ValueError("bad page")

    def missing():
        raise LookupError("nothing landed")

    report = loads.run_entities({"deals": start("deals", to_rows), "contacts": start("contacts", broken), "events": missing})
    assert [(e, s) for e, s, _ in report] == [("deals", "completed"), ("contacts", "failed"), ("events", "failed")]
    assert "bad page" in report[1][2]


def test_stop_between_batches(spark, tmp_path):
    rate = spark.readStream.format("rate").load()
    query = rate.writeStream.format("noop").queryName("endless").option("checkpointLocation", f"{tmp_path}/c").start()
    loads.stop_all(spark, ["other"])
    assert query.isActive
    loads.stop_all(spark, ["endless"])
    assert not query.isActive


def test_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"_embedded": {}}\nnot json\n')
    pages = landing.read_pages(spark, f"{tmp_path}/in", "leads")
    assert [r.raw for r in landing.quarantined(pages).collect()] == ["not json"]
    assert pages.select("entity").distinct().first().entity == "deals"


def test_typed_documents(spark):
    docs = spark.createDataFrame([('{"id": 1, "odd key": "x"}',), ('{"id": "text"}',)], "t string")
    typed = landing.typed_documents(docs.select(F.parse_json("t").alias("doc")), {"id": "bigint", "odd key": "string"})
    assert [(r["id"], r["odd key"]) for r in typed.collect()] == [(1, "x"), (None, None)]


# -- webhooks -----------------------------------------------------------------------------

@pytest.fixture
def feed(tmp_path):
    folder = tmp_path / "hooks"
    folder.mkdir()
    bodies = [
        {"event_type": "add_lead", "id": 1},
        {"event_type": "update_lead", "id": 2},
        {"event_type": "delete_contact", "id": 3},
        {"event_type": "foo", "id": 4},
        {"id": 5},
    ]
    for i, body in enumerate(bodies):
        (folder / f"{i}.json").write_text(json.dumps(body))
    return folder


def test_all_twelve_types_are_routed():
    routes = loads.event_types()
    assert len(routes) == 12 and routes["update_company"] == "companies" and routes["delete_lead"] == "deals"


def test_webhooks_store_all_and_reload_touched(spark, feed, tmp_path):
    reloaded = []
    query = loads.apply_webhooks(
        landing.stream_webhooks(spark, str(feed)),
        {},
        f"{tmp_path}/c",
        f"{tmp_path}/archive",
        reload=lambda entity, batch: reloaded.append((entity, batch)),
    )
    query.awaitTermination()
    assert reloaded == [("contacts", 0), ("deals", 0)]
    stored = spark.read.parquet(f"{tmp_path}/archive")
    assert stored.count() == 5 and stored.filter("entity is null").count() == 2
    assert stored.filter("_received_at is null").isEmpty()
    assert landing.read_webhooks(spark, str(feed)).count() == 5


def test_webhook_loads_what_has_landed(spark, feed, tmp_path):
    table = History(spark, f"{tmp_path}/deals", order_by=["page", "pos"])
    land(tmp_path / "landing" / "deals", 1, [{"id": 1, "v": "a"}])
    (tmp_path / "landing" / "contacts").mkdir()
    reload = loads.reload_landed(spark, f"{tmp_path}/landing", {"deals": table}, f"{tmp_path}/loads", {"deals": to_rows})
    for number in range(2):
        query = loads.apply_webhooks(
            landing.stream_webhooks(spark, str(feed)), {}, f"{tmp_path}/feed{number}", f"{tmp_path}/archive{number}", reload
        )
        query.awaitTermination()
    assert state(table) == [(1, "a")] and table.changes().count() == 1


@pytest.mark.parametrize("apply_deletes, left", [(False, [3, 4]), (True, [4])])
def test_deletes_are_opt_in(spark, feed, tmp_path, apply_deletes, left):
    contacts = History(spark, f"{tmp_path}/contacts", order_by=["seq"])
    contacts.append(spark.createDataFrame([(3, 1), (4, 1)], "id long, seq long"))
    loads.apply_webhooks(
        landing.stream_webhooks(spark, str(feed)), {"contacts": contacts}, f"{tmp_path}/c", f"{tmp_path}/archive", apply_deletes=apply_deletes
    ).awaitTermination()
    assert sorted(r.id for r in contacts.current().collect()) == left


def test_replayed_events_are_stored_once(spark, feed, tmp_path):
    def run():
        events = loads.without_replays(landing.stream_webhooks(spark, str(feed)), "1 hour")
        loads.apply_webhooks(events, {}, f"{tmp_path}/c", f"{tmp_path}/archive").awaitTermination()
        return sorted(r.raw for r in spark.read.parquet(f"{tmp_path}/archive").collect())

    first = run()
    assert len(first) == len(set(first)) == 5
    (feed / "again.json").write_text((feed / "0.json").read_text() + "\n" + (feed / "1.json").read_text())
    assert run() == first
    (feed / "new.json").write_text('{"event_type": "add_lead", "id": 9}\n{"event_type": "add_lead", "id": 9}')
    assert len(run()) == 6
    # An event from long before the newest of earlier batches counts as a replay.
    (feed / "late.json").write_text('{"event_type": "add_lead", "id": 10}')
    os.utime(feed / "late.json", (1, 1))
    assert len(run()) == 6


# -- paged source ----------------------------------------------------------------------------

@pytest.mark.parametrize("total, readers", [(23, 1), (23, 4), (20, 3), (0, 2)])
def test_paged_source_reads_every_page(spark, tmp_path, total, readers):
    folder = str(tmp_path)
    for page in range(1, total // 5 + 2):
        ids = range((page - 1) * 5, min(page * 5, total))
        (tmp_path / f"{page}.json").write_text(json.dumps([{"id": i} for i in ids]))

    def fetch(page):
        import json
        import os

        path = os.path.join(folder, f"{page}.json")
        return json.load(open(path)) if os.path.exists(path) else []

    source = paged_source(f"crm{total}{readers}", fetch)
    rows = read_paged(spark, source, "deals", pageSize=5, readers=readers)
    seen = rows.select(V.at(F.col("doc"), "$.id", "int").alias("id"), "page", "pos").collect()
    assert sorted(r.id for r in seen) == list(range(total))
    assert all(r.id == (r.page - 1) * 5 + r.pos for r in seen)


def test_a_range_reaches_the_paged_source(spark, tmp_path):
    asked = str(tmp_path)

    def fetch(page, low, high):
        """The service keeps ids 0 … 99, updated at their id; it answers the upper end only roughly."""
        import os

        os.makedirs(os.path.join(asked, f"{low}-{high}-{page}"), exist_ok=True)
        listed = [i for i in range(100) if (low is None or i >= low) and (high is None or i <= high + 3)]
        return [{"id": i, "updated_at": i if i % 10 else None} for i in listed[(page - 1) * 5 : page * 5]]

    rows = read_paged(spark, paged_source("ranged", fetch, ranged=True), "deals", pageSize=5, readers=2)
    ids = lambda df: sorted(r.id for r in df.select(V.at(F.col("doc"), "$.id", "int").alias("id")).collect())
    times = updated_range(rows, "1970-01-01T00:01:01", "1970-01-01T00:01:12")
    assert ids(times) == [i for i in range(61, 73) if i % 10]
    assert {name.rsplit("-", 1)[0] for name in os.listdir(asked)} == {"61-72"}
    assert len(os.listdir(asked)) <= 6  # of twenty pages
    assert ids(rows.filter("updated_at > 95 and page < 9")) == [96, 97, 98, 99]
    assert ids(rows.filter("updated_at > 95 or pos = 0")) == sorted({i for i in range(100) if i % 5 == 0} | {96, 97, 98, 99})
    assert ids(rows) == list(range(100))


def test_a_paged_stream_goes_on_where_it_stopped(spark, tmp_path):
    held = str(tmp_path / "held")
    (tmp_path / "asked").mkdir()
    asked = str(tmp_path / "asked")

    def fetch(page):
        import os
        import uuid

        open(os.path.join(asked, f"{page}-{uuid.uuid4().hex}"), "w").close()
        total = int(open(held).read())
        return [{"id": i, "updated_at": str(i)} for i in range((page - 1) * 5, min(page * 5, total))]

    def run(total):
        open(held, "w").write(str(total))
        for name in os.listdir(asked):
            os.remove(os.path.join(asked, name))
        rows = stream_paged(spark, paged_source("endless_pages", fetch), "deals", pageSize=5, readers=3)
        rows = rows.select(V.at(F.col("doc"), "$.id", "int").alias("id"), "page", "pos", "updated_at")
        sink = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
        sink.trigger(availableNow=True).start().awaitTermination()
        seen = spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").collect()
        assert sorted(r.id for r in seen) == list(range(total))  # none twice
        assert all(r.id == (r.page - 1) * 5 + r.pos and r.updated_at is None for r in seen)

    for total in (0, 3, 3, 12, 15, 64, 65):
        run(total)
    run(203)
    # Pages behind the place are fetched by readers, those before it only while the end is looked for.
    assert len(os.listdir(asked)) < 28 + 2 * 14
