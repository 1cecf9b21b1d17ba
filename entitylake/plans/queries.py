"""One query per capability on the driver tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions import cells, links
from entitylake.functions import variants as V
from entitylake.operators import chunks, delivery, documents, fields, filters, layouts, oplog, pages, progress, stats
from entitylake.operators import upsert as U
from entitylake.plans import exports
from entitylake.plans import standins as S
from entitylake.plans.standins import table
from entitylake.session import scratch_dir, stored
from entitylake.sources import paged
from entitylake.sources.history import History
from entitylake.sources.landing import stream_webhooks
from entitylake.sources.snapshots import Snapshot
from entitylake.streaming import highwater, loads, traces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- pages ----------------------------------------------------------------------

@query
def envelope_explode(spark, sf_dir):
    landed = S.deal_pages(spark, sf_dir).select("page", F.try_parse_json("value").alias("envelope"))
    rows = pages.explode_envelopes(landed, "leads")
    doc = F.col("doc")
    return rows.select(
        "page",
        F.col("pos").cast("bigint").alias("pos"),
        V.at(doc, "$.id", "bigint").alias("id"),
        V.at(doc, "$.status", "string").alias("status"),
        V.at(doc, "$.updated_at", "bigint").alias("updated_at"),
    )


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = table(spark, sf_dir, "orders").select(
        F.lit("deals").alias("entity"), F.expr("o_orderkey div 50 + 1").alias("page")
    )
    hour = F.floor(S.epoch("ts") / 3600)
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), hour.alias("page"))
    return pages.page_sizes(deals.union(events))


@query
def page_audit(spark, sf_dir):
    return pages.page_audit(page_sizes(spark, sf_dir))


@query
def union_batches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    second = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    third = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    return pages.union_batches([first, second, third])


@query
def expand_relations(spark, sf_dir):
    contact = F.col("o_custkey")
    related = F.when(F.col("o_orderstatus") == "O", F.array(contact, contact + 1)).when(
        F.col("o_orderstatus") == "F", F.array(contact)
    )
    nested = F.transform(F.coalesce(related, F.array().cast("array<bigint>")), lambda c: F.struct(c.alias("id")))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(nested).alias("customers"))
    expanded = documents.expand_relations(docs, "customers")
    return expanded.select("id", F.col("pos").cast("bigint").alias("pos"), V.at(F.col("related"), "$.id", "bigint").alias("related_id"))


# -- filters ---------------------------------------------------------------------

@query
def updated_range(spark, sf_dir):
    events = filters.updated_range(table(spark, sf_dir, "events"), "2024-01-08", "2024-01-15", column="ts")
    return events.select(F.col("event_id").alias("id"), S.epoch("ts").alias("updated_at"), "event_type")


@query
def updated_range_typed(spark, sf_dir):
    seconds = S.epoch("ts")
    given = F.when(F.col("event_type") == "error", seconds.cast("string").cast("variant")).otherwise(seconds.cast("variant"))
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), given.alias("updated_at"))
    return filters.updated_range(docs, "2024-01-08", "2024-01-15T12:00:00").select(
        "id", V.at(F.col("updated_at"), "$", "bigint").alias("updated_at")
    )


@query
def point_lookup(spark, sf_dir):
    found = filters.point_lookup(table(spark, sf_dir, "orders"), 7, key="o_orderkey")
    return found.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


# -- keyed changes ----------------------------------------------------------------

@query
def latest_by_id(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), S.epoch("ts").alias("updated_at"), "event_id", "event_type", "props"
    )
    return U.latest_by_id(events, order_by=("updated_at", "event_id"), total_order=True)


LINE_ORDER = (
    "shipped", "line", "part", "supplier", "quantity", "price", "discount", "tax", "flag", "line_status",
)


def stored_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note")
    )


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as one more version of its order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.concat("l_returnflag", "l_linestatus").alias("status"),
        F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("note"),
        F.col("l_shipdate").alias("shipped"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
    )


@query
def upsert_by_id(spark, sf_dir):
    merged = U.upsert(
        stored_deals(spark, sf_dir), line_changes(spark, sf_dir), order_by=LINE_ORDER, total_order=True
    )
    return merged.select("id", "status", "note")


@query
def replay_idempotent(spark, sf_dir):
    changes = line_changes(spark, sf_dir)
    once = U.upsert(stored_deals(spark, sf_dir), changes, order_by=LINE_ORDER, total_order=True)
    twice = U.upsert(once.select("id", "status", "note"), changes, order_by=LINE_ORDER, total_order=True)
    return twice.select("id", "status", "note")


@query
def upsert_outcome(spark, sf_dir):
    closed = stored_deals(spark, sf_dir).filter(F.col("status") == "F")
    return U.upsert_outcome(closed, line_changes(spark, sf_dir))


@query
def merge_fields(spark, sf_dir):
    changes = line_changes(spark, sf_dir)
    partial = changes.withColumns(
        {
            "status": F.when(F.col("flag") == "R", F.concat(F.lit("returned-"), F.col("line"))),
            "note": F.when(F.col("line_status") == "F", F.col("note")),
        }
    )
    return U.merge_fields(stored_deals(spark, sf_dir), partial, order_by=LINE_ORDER)


@query
def replace_all(spark, sf_dir):
    stored = stored_deals(spark, sf_dir)
    incoming = stored.filter(F.col("status") == "O")
    nothing = stored.filter(F.col("status") == "none")
    replaced = U.replace_all(stored, incoming).withColumn("delivery", F.lit("open deals"))
    kept = U.replace_all(stored, nothing).withColumn("delivery", F.lit("empty"))
    return replaced.union(kept)


@query
def replace_stored(spark, sf_dir):
    """A stored table replaced by open deals, then by nothing, then loaded on."""
    deals = History(spark, scratch_dir(spark, "replaced"))
    stored = stored_deals(spark, sf_dir)
    deals.append(stored)
    deals.replace(stored.filter(F.col("status") == "O"))
    deals.replace(stored.filter(F.col("status") == "none"))
    deals.append(stored.filter(F.col("status") == "P").withColumn("note", F.lit("later")))
    return deals.current()


@query
def merge_stored(spark, sf_dir):
    """A stored table whose changes carry some fields only, merged when it is read."""
    deals = History(spark, scratch_dir(spark, "merged"), order_by=("turn", *LINE_ORDER))
    deals.append(stored_deals(spark, sf_dir).withColumn("turn", F.lit(0)))
    partial = line_changes(spark, sf_dir).withColumns(
        {
            "status": F.when(F.col("flag") == "R", F.concat(F.lit("returned-"), F.col("line"))),
            "note": F.when(F.col("line_status") == "F", F.col("note")),
            "turn": F.lit(1),
        }
    )
    for parity in (0, 1):
        deals.append(partial.filter(F.col("line") % 2 == parity))
    return deals.merged().select("id", "status", "note")


@query
def delete_by_id(spark, sf_dir):
    returned = line_changes(spark, sf_dir).filter(F.col("flag") == "R").select("id")
    return U.delete_by_id(stored_deals(spark, sf_dir), returned)


@query
def delete_outcome(spark, sf_dir):
    stored = stored_deals(spark, sf_dir).filter(F.col("status") == "P")
    returned = line_changes(spark, sf_dir).filter(F.col("flag") == "R").select("id")
    return U.delete_outcome(stored, returned)


# -- custom fields and layouts -----------------------------------------------------

@query
def links_url(spark, sf_dir):
    url = F.col("url")
    nested = F.struct(F.struct(url.alias("href")).alias("self"))
    form = F.col("page_id") % 4
    given = (
        F.when(form == 0, F.to_variant_object(nested))
        .when(form == 1, F.to_json(nested).cast("variant"))
        .when(form == 2, url.cast("variant"))
        .otherwise(F.to_variant_object(F.array(url)))
    )
    docs = table(spark, sf_dir, "pages").select("page_id", given.alias("_links"))
    variant = T.VariantType()
    return docs.select(
        F.col("page_id").alias("id"),
        links.workbook_link(F.col("_links"), variant).alias("workbook_url"),
        links.sheet_link(F.col("_links"), variant).alias("sheet_url"),
    )


@query
def field_types(spark, sf_dir):
    return fields.field_types(S.deals(spark, sf_dir))


@query
def custom_long(spark, sf_dir):
    deals = S.deals(spark, sf_dir)
    long = fields.attach_types(fields.fields_long(deals, ["id"]), fields.field_types(deals))
    return long.select("id", F.col("pos").cast("bigint").alias("pos"), "field_id", "field_name", "field_type")


@query
def custom_values(spark, sf_dir):
    deals = S.deals(spark, sf_dir)
    values = layouts.custom_values(deals, fields.field_types(deals), ["id"])
    return values.select("id", "field_id", "field_name", "workbook_value", "sheet_value")


@query
def field_profile(spark, sf_dir):
    frames = {"deals": S.deals, "contacts": S.contacts, "companies": S.companies, "events": S.events}
    return pages.union_batches([stats.field_profile(frame(spark, sf_dir), entity) for entity, frame in frames.items()])


@query
def wide_by_field_id(spark, sf_dir):
    deals = S.deals(spark, sf_dir)
    return layouts.workbook_table(deals, fields.custom_columns(deals))


@query
def wide_typed(spark, sf_dir):
    deals = S.deals(spark, sf_dir)
    wide = layouts.workbook_table(deals, fields.custom_columns(deals), typed=True)
    typed = {"custom_Total_13": F.round("custom_Total_13", 2), "custom_Ordered_14": F.col("custom_Ordered_14").cast("string")}
    return wide.withColumns(typed)


@query
def wide_by_name(spark, sf_dir):
    deals = S.deals(spark, sf_dir)
    return layouts.sheet_table(deals, fields.custom_columns(deals))


@query
def sheet_rows(spark, sf_dir):
    contacts = S.contacts(spark, sf_dir)
    return layouts.sheet_table(contacts, fields.custom_columns(contacts))


@query
def header_union(spark, sf_dir):
    frames = [S.deals(spark, sf_dir), S.contacts(spark, sf_dir), S.companies(spark, sf_dir), S.events(spark, sf_dir)]
    docs = [
        df.select(F.to_variant_object(F.struct(*[F.col(c) for c in df.columns if c != "custom_fields_values"])).alias("doc"))
        for df in frames
    ]
    custom = [fields.fields_long(df, ["id"], headers_only=True).select(F.col("field_name").alias("key")) for df in frames[:2]]
    headers = documents.header_union(pages.union_batches(docs), more=pages.union_batches(custom))
    return spark.createDataFrame(list(enumerate(headers)), "pos bigint, header string")


# -- cells ---------------------------------------------------------------------------

def planted(by: Column, *texts: Column) -> Column:
    """VARIANT of the JSON text chosen by ``by``."""
    chosen = texts[-1]
    for number, text in reversed(list(enumerate(texts[:-1]))):
        chosen = F.when(by == number, text).otherwise(chosen)
    return F.parse_json(chosen)


def probe(df: DataFrame) -> DataFrame:
    """Add text and kind of the VARIANT ``v``."""
    return df.withColumns({"text": V.text_of(F.col("v")), "kind": F.schema_of_variant("v")})


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


@query
def numeric_cells(spark, sf_dir):
    balance, key = F.col("c_acctbal"), F.col("c_custkey")
    whole = F.floor(balance).cast("string")
    value = planted(
        key % 8,
        quoted(balance.cast("string")),
        quoted(F.concat(whole, F.lit(".0"))),
        quoted(F.concat(F.lit(" "), whole, F.lit(" "))),
        quoted(F.concat(F.lit("abc"), whole)),
        F.concat(whole, F.lit("e2")),
        F.lit("null"),
        F.concat(key + 10_000_000, F.lit(".25")),  # from 10^7 on, doubles print with an exponent
        F.concat(F.lit("0.000"), key % 9 + 1, F.lit("5")),
    )
    probed = probe(table(spark, sf_dir, "customer").select(key.alias("id"), value.alias("v")))
    numbered = probed.withColumn("n", cells.number_of(F.col("text"), F.col("kind")))
    return numbered.select("id", cells.number_text(F.col("n"), F.col("text")).alias("cell"))


@query
def date_cells(spark, sf_dir):
    key = F.col("event_id")
    seconds = S.epoch("ts").cast("string")
    date = F.date_format("ts", "yyyy-M-d")
    value = planted(
        key % 7,
        seconds,
        quoted(seconds),
        quoted(date),
        quoted(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        quoted(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
        F.lit("0"),
        F.lit("null"),
    )
    rows = probe(table(spark, sf_dir, "events").select(key.alias("id"), value.alias("v")))
    text, kind = F.col("text"), F.col("kind")
    rows = rows.withColumns({t: cells.moment_of(text, kind, t) for t in ("date", "datetime")})
    return rows.select(
        "id",
        cells.moment_cell(F.col("date"), text, "date").alias("date_cell"),
        cells.moment_cell(F.col("datetime"), text, "datetime").alias("datetime_cell"),
        cells.top_level_cell(text, kind).alias("top_level_cell"),
    )


@query
def plus_guard(spark, sf_dir):
    name = F.when(F.col("c_nationkey") < 12, F.concat(F.lit("+"), F.col("c_name"))).otherwise(F.col("c_name"))
    once = cells.plus_guard(name)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), once.alias("cell"), cells.plus_guard(once).alias("cell_again")
    )


@query
def nested_json(spark, sf_dir):
    deals = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>"))
        .otherwise(F.array("o_orderstatus", "o_orderpriority"))
        .alias("tags"),
        F.struct(F.col("o_custkey").alias("contact"), F.col("o_orderpriority").alias("p")).alias("main"),
    )
    deals = deals.withColumn("extra", F.col("tags"))
    return layouts.sheet_table(deals, [])


@query
def cell_errors(spark, sf_dir):
    key = F.col("event_id")
    seconds = S.epoch("ts")
    far = F.when(F.col("event_type") == "error", seconds * 100_000_000).otherwise(seconds)
    values = F.when(F.col("event_type") == "view", '{"value":1}').otherwise('[{"value":"x"}]')
    custom = F.concat(
        F.lit('[{"field_id":1,"field_name":"Broken","field_type":"text","values":'),
        values,
        F.lit('},{"field_id":2,"field_name":"Due","field_type":"date","values":[{"value":'),
        far.cast("string"),
        F.lit("}]}]"),
    )
    docs = table(spark, sf_dir, "events").select(
        key.alias("id"), far.alias("updated_at"), custom.alias("custom_fields_values")
    )
    sheet = layouts.sheet_table(docs, fields.custom_columns(docs), errors=True)
    return sheet.withColumn("_errors", F.array_join("_errors", ","))


@query
def sheet_chunks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return chunks.with_chunks(chunks.with_row_numbers(orders, "id"))


# -- delivery -------------------------------------------------------------------------

def delivered(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "leads": S.deals(spark, sf_dir),
        "contacts": S.contacts(spark, sf_dir),
        "companies": S.companies(spark, sf_dir),
        "events": S.events(spark, sf_dir),
    }


def without_companies(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same with an entity that has no rows, which is what placeholders and reports are about."""
    frames = delivered(spark, sf_dir)
    return {**frames, "companies": frames["companies"].filter(F.col("balance") > 1e9)}


@query
def empty_placeholder(spark, sf_dir):
    return delivery.empty_placeholders(without_companies(spark, sf_dir))


TARGETS = {"leads": "sheet-deals", "contacts": "sheet-contacts", "companies": "sheet-companies"}


@query
def target_lookup(spark, sf_dir):
    rows = [df.select(F.lit(name).alias("entity"), "id") for name, df in delivered(spark, sf_dir).items()]
    return delivery.with_target(pages.union_batches(rows), TARGETS).select("entity", "id", "target")


@query
def export_report(spark, sf_dir):
    frames = without_companies(spark, sf_dir)
    return exports.export_sheets(spark, frames, scratch_dir(spark, "sheets"), TARGETS)


@query
def workbook_report(spark, sf_dir):
    frames = without_companies(spark, sf_dir)
    return exports.export_workbook(spark, frames, scratch_dir(spark, "workbook"), date_from="1970-02-01")


# -- operation log, progress, counts ----------------------------------------------------

@query
def logs_recent(spark, sf_dir):
    logs = S.logs(spark, sf_dir)
    recent = oplog.recent_logs(logs, count=30, message="user 1.* did", level="warning", ties=("event_id",))
    return recent.select("event_id", F.unix_seconds("timestamp").alias("at"), "component", "level", "message")


@query
def logs_retention(spark, sf_dir):
    kept = oplog.retained(S.logs(spark, sf_dir), oplog.cutoff(datetime(2024, 1, 31)))
    return kept.select("event_id", F.unix_seconds("timestamp").alias("at"), "component")


@query
def entity_stats(spark, sf_dir):
    frames = {**delivered(spark, sf_dir), "logs": S.logs(spark, sf_dir)}
    return stats.entity_counts(frames, with_logs=True)


@query
def webhook_counts(spark, sf_dir):
    return stats.webhook_counts(table(spark, sf_dir, "events"))


@query
def progress_status(spark, sf_dir):
    status = progress.export_status(S.progress_events(spark, sf_dir))
    return status.select(
        "entity",
        "running",
        "completed",
        F.col("last_page").cast("bigint").alias("last_page"),
        F.unix_seconds("last_update").alias("last_update"),
    )


@query
def resume_point(spark, sf_dir):
    points = progress.resume_points(progress.export_status(S.progress_events(spark, sf_dir)))
    return points.select("entity", F.col("next_page").cast("bigint").alias("next_page"))


@query
def running_valid(spark, sf_dir):
    valid = table(spark, sf_dir, "events").select(
        F.coalesce(loads.routed_entity(F.col("event_type"), S.EVENT_ROUTES), F.lit("none")).alias("entity")
    )
    return progress.verify_running(S.progress_events(spark, sf_dir), valid.filter("entity <> 'none'"))


@query
def page_progress(spark, sf_dir):
    return pages.progress_of_pages(page_sizes(spark, sf_dir))


# -- change feed --------------------------------------------------------------------------

@query
def webhook_route(spark, sf_dir):
    routed = loads.routed_entity(F.col("event_type"), S.EVENT_ROUTES)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", routed.alias("entity"))


@query
def webhook_stream(spark, sf_dir):
    folder = scratch_dir(spark, "webhooks")
    body = F.to_json(F.struct("event_id", "user_id", "event_type", S.epoch("ts").alias("at"), F.col("props")))
    events = table(spark, sf_dir, "events").select(body.alias("value"), F.to_date("ts").alias("day"))
    events.write.partitionBy("day").text(f"{folder}/landing")
    feed = stream_webhooks(spark, f"{folder}/landing")
    people = History(spark, f"{folder}/table", order_by=("updated_at", "event_id"))
    body = F.col("body")
    rows = feed.select(
        V.at(body, "$.user_id", "bigint").alias("id"),
        V.at(body, "$.at", "bigint").alias("updated_at"),
        V.at(body, "$.event_id", "bigint").alias("event_id"),
        "event_type",
        V.at(body, "$.props", "string").alias("props"),
    )
    people.stream(rows, f"{folder}/checkpoint", "people").awaitTermination()
    return people.current().select("id", "updated_at", "event_id", "event_type", "props")


def loaded_deals(spark: SparkSession, pages: DataFrame, to_rows: Callable[[DataFrame], DataFrame], **how: str) -> History:
    """Pages (value) landed as text and loaded."""
    folder = scratch_dir(spark, "pages")
    pages.select("value").write.text(f"{folder}/landing")
    deals = History(spark, f"{folder}/table", order_by=("page", "pos"))
    loads.load_pages(spark, f"{folder}/landing", "deals", deals, f"{folder}/checkpoint", to_rows, 100, **how).awaitTermination()
    return deals


@query
def page_load(spark, sf_dir):
    def to_rows(documents: DataFrame) -> DataFrame:
        doc = F.col("doc")
        return documents.select(
            V.at(doc, "$.id", "bigint").alias("id"),
            V.at(doc, "$.status", "string").alias("status"),
            V.at(doc, "$._links.self.href", "string").alias("link_url"),
            "page",
            "pos",
        )

    deals = loaded_deals(spark, S.deal_pages(spark, sf_dir), to_rows)
    return deals.current().select("id", "status", "link_url", "page")


@query
def page_load_range(spark, sf_dir):
    """Landed pages loaded for a range of dates."""

    def to_rows(documents: DataFrame) -> DataFrame:
        doc = F.col("doc")
        return documents.select(V.at(doc, "$.id", "bigint").alias("id"), V.at(doc, "$.updated_at", "bigint").alias("updated_at"), "page", "pos")

    deals = loaded_deals(spark, S.deal_pages(spark, sf_dir), to_rows, date_from="1994-01-01", date_to="1995-12-31")
    return deals.current().select("id", "updated_at")


def fetched_deals(rows: DataFrame) -> DataFrame:
    doc = F.col("doc")
    return rows.select(V.at(doc, "$.id", "bigint").alias("id"), V.at(doc, "$.status", "string").alias("status"), "updated_at")


@query
def paged_range(spark, sf_dir):
    """Deals fetched from a paged service that is asked for a range of dates only."""
    folder = scratch_dir(spark, "listing")
    S.write_listing(S.deal_listing(spark, sf_dir, "updated_at"), folder)
    source = paged.paged_source("deals_by_time", S.listing_service(folder), ranged=True)
    return fetched_deals(filters.updated_range(paged.read_paged(spark, source, "deals"), "1994-01-01", "1995-12-31"))


@query
def paged_stream(spark, sf_dir):
    """Deals streamed from a paged service, twice, with more of them the second time; how often each has been loaded."""
    folder = scratch_dir(spark, "listing")
    listing = S.deal_listing(spark, sf_dir, "id")
    middle = listing.agg(F.max("page")).first()[0] // 2
    deals = History(spark, f"{folder}/table", order_by=("updated_at",))
    source = paged.paged_source("deals_by_id", S.listing_service(f"{folder}/pages"))
    for part in (F.col("page") <= middle, F.col("page") > middle):
        S.write_listing(listing.filter(part), f"{folder}/pages")
        rows = fetched_deals(paged.stream_paged(spark, source, "deals"))
        deals.stream(rows, f"{folder}/checkpoint", "paged-deals").awaitTermination()
    return deals.changes().groupBy("id", "status", "updated_at").agg(F.count("*").alias("loads"))


@query
def load_traces(spark, sf_dir):
    """Progress and log of a load, read back after it."""

    def to_rows(documents: DataFrame) -> DataFrame:
        return documents.select(V.at(F.col("doc"), "$.id", "bigint").alias("id"), "page", "pos")

    deals = loaded_deals(spark, S.deal_pages(spark, sf_dir), to_rows)
    folder = scratch_dir(spark, "traces")
    loads.record_load(deals, "leads", f"{folder}/progress", f"{folder}/log")
    events = spark.read.schema(progress.PROGRESS_SCHEMA).parquet(f"{folder}/progress")
    status = progress.export_status(events).select("entity", F.col("last_page").cast("bigint").alias("page"), "completed")
    entries = oplog.recent_logs(spark.read.parquet(f"{folder}/log"), count=0, message="loaded", level="info")
    return pages.union_batches([status, entries.select(F.col("component").alias("entity"), "message")])


@query
def load_events(spark, sf_dir):
    """Progress events of three loads: over half of the pages, over the others, and with nothing new."""

    def to_rows(documents: DataFrame) -> DataFrame:
        return documents.select(V.at(F.col("doc"), "$.id", "bigint").alias("id"), "page", "pos")

    folder = scratch_dir(spark, "events")
    landed = S.deal_pages(spark, sf_dir)
    middle = landed.agg(F.max("page")).first()[0] // 2
    deals = History(spark, f"{folder}/table", order_by=("page", "pos"))
    with traces.traced(spark, f"{folder}/events") as told:
        for part in (F.col("page") <= middle, F.col("page") > middle, F.lit(False)):
            landed.filter(part).select("value").write.mode("append").text(f"{folder}/landing")
            told.wait(loads.load_pages(spark, f"{folder}/landing", "deals", deals, f"{folder}/checkpoint", to_rows, 100))
    events = traces.load_events(spark, f"{folder}/events")
    status = progress.export_status(events).select("entity", "completed", F.col("last_page").cast("bigint").alias("page"))
    totals = events.groupBy(F.col("entity").alias("of")).agg(F.sum("documents").alias("documents"), F.count("*").alias("events"))
    joined = status.join(totals, F.col("entity") == F.col("of"), "left")
    return joined.select("entity", "page", "completed", F.coalesce("documents", F.lit(0)).alias("documents"))


@query
def snapshot_current(spark, sf_dir):
    """Deals folded into a snapshot, with later changes, deletions and new ids, half of them folded too."""
    folder = scratch_dir(spark, "snapshot")
    orders = table(spark, sf_dir, "orders")
    first = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), S.epoch("o_orderdate").alias("updated_at"))
    deals = History(spark, f"{folder}/table", order_by=("updated_at",))
    snapshot = Snapshot(deals, buckets=16)
    deals.append(first)
    snapshot.fold()
    later = first.withColumn("updated_at", F.col("updated_at") + 1)
    deals.append(later.filter("id % 7 = 0").withColumn("status", F.lit("changed")))
    deals.append(later.filter("id % 11 = 0").withColumns({"id": -F.col("id"), "status": F.lit("new")}))
    deals.delete(first.filter("id % 13 = 0").select("id"))
    snapshot.fold()
    deals.append(first.filter("id % 17 = 0").withColumns({"status": F.lit("last"), "updated_at": F.col("updated_at") + 2}))
    deals.append(first.filter("id % 19 = 0").withColumns({"status": F.lit("stale"), "updated_at": F.col("updated_at") - 1}))
    return snapshot.current()


@query
def highwater_resume(spark, sf_dir):
    """Deals loaded twice, with every seventh one updated in between; how often each has been loaded."""
    folder = scratch_dir(spark, "highwater")
    orders = table(spark, sf_dir, "orders")
    first = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), S.epoch("o_orderdate").alias("updated_at"))
    deals = History(spark, f"{folder}/table", order_by=("updated_at",))
    marks = highwater.HighWater(spark, f"{folder}/marks")
    highwater.load_changed(first, deals, marks, "leads")
    newest = marks.of("leads")
    changed = F.col("id") % 7 == 0
    second = first.select(
        "id",
        F.when(changed, "changed").otherwise(F.col("status")).alias("status"),
        F.when(changed, F.lit(newest) + 1 + F.col("id")).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    second.write.parquet(f"{folder}/source")
    highwater.load_changed(spark.read.parquet(f"{folder}/source"), deals, marks, "leads")
    loaded = deals.changes().groupBy(F.col("id").alias("of")).agg(F.count("*").alias("loads"))
    current = deals.current()
    return current.join(loaded, F.col("id") == F.col("of")).select("id", "status", "updated_at", "loads")


@query
def highwater_marks(spark, sf_dir):
    """Each entity's mark after two loads, the second of which finds nothing newer than the mark."""
    folder = scratch_dir(spark, "marks")
    marks = highwater.HighWater(spark, f"{folder}/marks")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.epoch("o_orderdate").alias("updated_at"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), S.epoch("ts").alias("updated_at"))
    for entity, rows in (("leads", orders), ("events", events)):
        for _ in range(2):
            highwater.load_changed(rows, History(spark, f"{folder}/{entity}", order_by=("updated_at",)), marks, entity)
    return marks.marks().select("entity", "mark", "loads")


@query
def logs_expired(spark, sf_dir):
    """A stored log after its old days were dropped and the day of the cutoff rewritten."""
    path = scratch_dir(spark, "log")
    oplog.append_log(S.logs(spark, sf_dir), path)
    oplog.drop_expired(spark, path, oplog.cutoff(datetime(2024, 1, 31, 12)))
    return spark.read.parquet(path).select("event_id", F.unix_seconds("timestamp").alias("at"), "component", "level")


@query
def stored_export(spark, sf_dir):
    """Landed pages with custom fields, kept as whole documents, delivered as a wide table."""

    def to_rows(documents: DataFrame) -> DataFrame:
        return documents.select(V.at(F.col("doc"), "$.id", "string").alias("id"), "page", "pos", F.col("doc").cast("string").alias("text"))

    deals = loaded_deals(spark, S.whole_deal_pages(spark, sf_dir), to_rows).current()
    deals = stored(deals.select("text"), "current")  # read three times: for keys, fields and cells
    whole = deals.select(F.parse_json("text").alias("doc"))
    docs = documents.expand_documents(whole, documents.header_union(whole))
    wide = layouts.workbook_table(docs, fields.custom_columns(docs))
    return wide.select(*[V.named(c).cast("string").alias(c) for c in wide.columns])


@query
def webhook_reload(spark, sf_dir):
    """Events as the routed types: stored, their entities reloaded, deleted deals gone."""
    folder = scratch_dir(spark, "feed")
    S.deal_pages(spark, sf_dir).select("value").write.text(f"{folder}/landing/deals")
    kinds = F.array(*[F.lit(kind) for kind in (*sorted(loads.event_types()), "unknown_lead")])
    kind = F.element_at(kinds, (F.col("event_id") % F.size(kinds) + 1).cast("int"))
    body = F.to_json(F.struct(kind.alias("event_type"), F.col("event_id").alias("id")))
    table(spark, sf_dir, "events").select(body.alias("value")).write.text(f"{folder}/hooks")
    deals = History(spark, f"{folder}/table", order_by=("page", "pos"))
    to_rows = lambda docs: docs.select(V.at(F.col("doc"), "$.id", "bigint").alias("id"), "page", "pos")
    reload = loads.reload_landed(spark, f"{folder}/landing", {"deals": deals}, f"{folder}/loads", {"deals": to_rows})
    loads.apply_webhooks(
        stream_webhooks(spark, f"{folder}/hooks"), {"deals": deals}, f"{folder}/checkpoint", f"{folder}/archive", reload, True
    ).awaitTermination()
    archive = spark.read.parquet(f"{folder}/archive").groupBy("entity", "event_type").agg(F.count("*").alias("n"))
    left = deals.current().select(F.lit("deals").alias("entity"), F.lit("row").alias("event_type"), F.col("id").alias("n"))
    return archive.unionByName(left)


@query
def webhook_replay(spark, sf_dir):
    """Events that land twice, in one batch and in a later one, stored once."""
    folder = scratch_dir(spark, "replays")
    body = F.to_json(F.struct("event_type", F.col("event_id").alias("id"), S.epoch("ts").alias("at")))
    events = table(spark, sf_dir, "events").select(body.alias("value"))
    for times in (2, 1):
        events.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(times)))).select("value").write.mode("append").text(f"{folder}/hooks")
        feed = loads.without_replays(stream_webhooks(spark, f"{folder}/hooks"), "1 day")
        loads.apply_webhooks(feed, {}, f"{folder}/checkpoint", f"{folder}/archive", routes=S.EVENT_ROUTES).awaitTermination()
    archive = spark.read.parquet(f"{folder}/archive")
    return archive.groupBy("entity", "event_type", "object_id").agg(F.count("*").alias("n"))
