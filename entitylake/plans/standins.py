"""The driver tables dressed as CRM data.

orders are deals, customers contacts, suppliers companies, events events.
Irregular values (empty lists, junk elements, text in place of numbers) are
planted by id in every table's full length, so each rule meets real volume.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.operators.chunks import with_row_numbers
from entitylake.operators.partitioning import spread
from entitylake.session import configure

# Python workers get a service with its data source and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
# Fixed value: a reader holds the rows of one group.
ROW_GROUP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(moment: str | Column) -> Column:
    column = F.col(moment) if isinstance(moment, str) else moment
    return F.unix_seconds(column.cast("timestamp"))


def href(entity: str, key: Column) -> Column:
    return F.concat(F.lit(f"https://crm.example/{entity}/"), key.cast("string"))


def link(entity: str, key: Column) -> Column:
    return F.struct(F.struct(href(entity, key).alias("href")).alias("self"))


def field(field_id: int, name: str, field_type: str | Column, *values: Column) -> Column:
    """JSON text of one custom field."""
    kind = F.lit(field_type) if isinstance(field_type, str) else field_type
    listed = F.array(*[F.struct(v.alias("value")) for v in values])
    return F.to_json(
        F.struct(
            F.lit(field_id).alias("field_id"),
            F.lit(name).alias("field_name"),
            kind.alias("field_type"),
            listed.alias("values"),
        ),
        {"ignoreNullFields": "false"},
    )


def deal_fields() -> Column:
    """Custom fields of an order as JSON text, irregular elements included."""
    key, status, priority, total = (F.col(c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))
    total_type = F.when(F.year("o_orderdate") < 1996, "text").otherwise("numeric")
    parts = [
        F.when(key % 5 == 0, "1"),  # not an object
        F.when(key % 4 == 0, field(0, "Nothing", "text", status)),  # no id
        field(10, "Status", "select", status),
        field(11, "Priority", "text", F.when(key % 11 == 0, F.concat(F.lit("+"), priority)).otherwise(priority)),
        field(12, "Tags", "multiselect", status, F.lit(None).cast("string"), priority),
        F.when(key % 2 == 0, field(13, "Total", total_type, total.cast("string"))).otherwise(
            field(13, "Total", total_type, total)
        ),
        field(14, "Ordered", "date", epoch("o_orderdate")),
        F.when(key % 6 == 0, field(15, "Status", "select")).when(key % 3 == 0, field(15, "Status", "select", F.lower(status))),
        F.when(key % 9 == 0, field(16, "price", "text", F.lit("override"))),
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        key.alias("id"),
        F.col("o_custkey").alias("contact_id"),
        F.col("o_totalprice").alias("price"),
        epoch("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderstatus") == "F", epoch("o_orderdate")).otherwise(0).alias("closed_at"),
        F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>"))
        .otherwise(F.array("o_orderstatus", "o_orderpriority"))
        .alias("tags"),
        link("deals", key).alias("_links"),
        deal_fields().alias("custom_fields_values"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("+"), F.col("c_nationkey"), F.lit("-"), key).alias("phone"),
        (key * 3600).alias("updated_at"),
        link("contacts", key).alias("_links"),
        F.concat(F.lit("["), field(20, "Segment", "select", F.col("c_mktsegment")), F.lit("]")).alias(
            "custom_fields_values"
        ),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
        (key * 7200).alias("updated_at"),
        link("companies", key).alias("_links"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        key.alias("id"),
        F.col("event_type").alias("type"),
        F.col("user_id").alias("created_by"),
        epoch("ts").alias("created_at"),
        epoch("ts").alias("updated_at"),
        F.try_parse_json("props").alias("props"),
    )


def deal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, value): API pages of fifty orders each as envelope text."""
    key = F.col("o_orderkey")
    document = F.struct(
        key.alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        epoch("o_orderdate").alias("updated_at"),
        link("deals", key).alias("_links"),
    )
    page = F.expr("o_orderkey div 50 + 1")
    rows = table(spark, sf_dir, "orders").select(page.alias("page"), document.alias("document"))
    # An id range of fifty bounds each group.
    paged = rows.groupBy("page").agg(F.array_sort(F.collect_list("document")).alias("leads"))
    envelope = F.struct(F.col("page").alias("_page"), F.struct("leads").alias("_embedded"))
    return paged.select("page", F.to_json(envelope).alias("value"))


def whole_deal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, value): API pages of all that ``deals`` has; every seventh has no update time, every fifth a text id."""
    rows = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    own = F.struct(
        F.when(key % 5 != 0, key).alias("id"),
        F.when(key % 5 == 0, key.cast("string")).alias("text_id"),
        F.col("o_totalprice").alias("price"),
        F.when(key % 7 != 0, epoch("o_orderdate")).alias("updated_at"),
        link("deals", key).alias("_links"),
    )
    # The custom fields are a list beside the others, not a text.
    text = F.concat(F.expr("substring(t, 1, length(t) - 1)"), F.lit(',"custom_fields_values":'), F.col("fields"), F.lit("}"))
    paged = rows.select(F.expr("o_orderkey div 50 + 1").alias("page"), F.regexp_replace(F.to_json(own), '"text_id"', '"id"').alias("t"), deal_fields().alias("fields"))
    paged = paged.select("page", text.alias("document")).groupBy("page").agg(F.array_sort(F.collect_list("document")).alias("documents"))
    value = F.concat(F.lit('{"_page":'), F.col("page").cast("string"), F.lit(',"_embedded":{"leads":['), F.array_join("documents", ","), F.lit("]}}"))
    return paged.select("page", value.alias("value"))


# Stand-in for the webhook types: which entity an event of a type concerns.
EVENT_ROUTES = {"click": "deals", "view": "contacts", "signup": "companies", "purchase": "events"}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as operation log."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warning").otherwise("info")
    message = F.concat(F.lit("User "), F.col("user_id"), F.lit(" did "), F.initcap("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("component"),
        level.alias("level"),
        message.alias("message"),
        F.col("props").alias("details"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as load progress and run registry.

    Purchases restart an entity's progress; errors belong to an entity nobody
    knows. A third of the users report a page, the others start a run; only
    runs of viewed entities are ended, by half of these.
    """
    entity = F.when(F.col("event_type") == "purchase", "leads").otherwise(
        F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_ROUTES.items() for x in kv]), F.col("event_type"))
    )
    third = F.col("user_id") % 3
    kind = (
        F.when(F.col("value") > 400, "reset")
        .when(third == 0, "progress")
        .when((third == 1) | (F.col("event_type") != "view"), "started")
        .otherwise("stopped")
    )
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "unknown").otherwise(entity).alias("entity"),
        kind.alias("kind"),
        (F.expr("event_id div 50") + 1).cast("int").alias("page"),
        (F.col("event_id") % 50 == 49).alias("completed"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def deal_listing(spark: SparkSession, sf_dir: str, order_by: str) -> DataFrame:
    """(page, id, status, updated_at): orders listed by ``id`` or ``updated_at`` in pages of fifty without gaps."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), epoch("o_orderdate").alias("updated_at")
    )
    place = F.col("id") if order_by == "id" else F.shiftleft("updated_at", 33) + F.col("id")
    numbered = with_row_numbers(rows.withColumn("_place", place), "_place")
    return numbered.select(F.expr("rn div 50 + 1").alias("page"), "id", "status", "updated_at")


def write_listing(listing: DataFrame, path: str) -> None:
    """Pages as files that a service can look up by page: ranges of pages, sorted, in small row groups."""
    ranges = listing.repartitionByRange("page").sortWithinPartitions("page", "id")
    ranges.write.mode("append").option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)


class Listing:
    """Such files as one reader sees them: statistics of all row groups, and the rows of the last group it read."""

    COLUMNS = ("id", "status", "updated_at")

    def __init__(self, path: str) -> None:
        import numpy as np
        import pyarrow.dataset as ds

        self.groups, spans = [], []
        for part in ds.dataset(path, format="parquet").get_fragments():
            part.ensure_complete_metadata()
            for group in part.row_groups:
                known = group.statistics or {}
                self.groups.append(part.subset(row_group_ids=[group.id]))
                spans.append([known.get(c, {}).get(end) for c in ("page", "updated_at") for end in ("min", "max")])
        low, high = -(1 << 63), (1 << 63) - 1
        given = [[s if s is not None else (high if i % 2 else low) for i, s in enumerate(span)] for span in spans]
        self.first, self.last, _, self.newest = np.array(given, np.int64).reshape(-1, 4).T
        self.at, self.rows, self.pages = -1, None, None

    def read(self, group: int) -> None:
        if group != self.at:
            self.rows = self.groups[group].to_table(columns=["page", *self.COLUMNS], use_threads=False)
            self.at, self.pages = group, self.rows.column("page").to_numpy()

    def begin(self, low: int) -> int | None:
        """The page of the first row that is not older; groups of older rows are not read."""
        import numpy as np
        import pyarrow.compute as pc

        for group in np.flatnonzero(self.newest >= low).tolist():
            self.read(group)
            found = self.rows.column("page").filter(pc.greater_equal(self.rows.column("updated_at"), low))
            if len(found):
                return found[0].as_py()
        return None

    def page(self, number: int) -> list:
        import numpy as np

        found = []
        for group in np.flatnonzero((self.first <= number) & (self.last >= number)).tolist():
            self.read(group)
            start, end = np.searchsorted(self.pages, [number, number + 1])  # groups are sorted by page
            found += self.rows.slice(start, end - start).select(self.COLUMNS).to_pylist()
        return found


def listing_service(path: str) -> Callable[..., list]:
    """``fetch(page, low, high)`` of a service that answers from such files; in a range by ``updated_at``, page 1 is the one where it begins."""

    opened: dict = {}  # a reader opens the files once

    def fetch(page: int, low: int | None = None, high: int | None = None) -> list:
        if "pages" not in opened:
            opened["pages"] = Listing(path)
        pages = opened["pages"]
        if low is not None:
            if low not in opened:
                opened[low] = pages.begin(low)
            if opened[low] is None:
                return []
            page += opened[low] - 1
        rows = pages.page(page)
        return rows if high is None else [r for r in rows if r["updated_at"] is not None and r["updated_at"] <= high]

    return fetch
