"""Landed pages: envelopes, audit, concatenation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylake.functions import variants as V
from entitylake.operators.explode import positions
from entitylake.specs import ENTITIES, canonical_name

PAGE_SIZE = 50  # Fixed value.


def explode_envelopes(pages: DataFrame, entity: str, envelope: str = "envelope") -> DataFrame:
    """Documents of page envelopes: page columns, ``pos`` and ``doc``.

    A page without the entity has no documents.
    """
    spec = ENTITIES.get(canonical_name(entity))
    below = spec.envelope if spec else entity
    rows = V.at(V.named(envelope), f"$._embedded.{below}", "array<variant>")
    others = [V.named(c) for c in pages.columns if c != envelope]
    return positions(pages, others, rows, "doc")


def envelope_sizes(pages: DataFrame, entity: str, envelope: str = "envelope") -> DataFrame:
    """(page columns, n_rows) per page; an empty or missing list counts zero."""
    spec = ENTITIES.get(canonical_name(entity))
    below = spec.envelope if spec else entity
    rows = V.at(V.named(envelope), f"$._embedded.{below}", "array<variant>")
    others = [V.named(c) for c in pages.columns if c != envelope]
    size = F.when(rows.isNull(), 0).otherwise(F.size(rows)).cast("bigint")
    return pages.select(*others, size.alias("n_rows"))


def page_sizes(documents: DataFrame) -> DataFrame:
    return documents.groupBy("entity", "page").agg(F.count("*").alias("n_rows"))


def page_audit(sizes: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Per page: whether more follow, the next landed page, and whether pages are missing.

    Works on one row per page, so the window over an entity's page sequence
    is a fiftieth of the data at most; it is cut into ranges of pages, each
    knowing the first page of the next, so that no entity is one task.
    """
    span = 10_000
    ranged = sizes.withColumn("_range", F.expr(f"page div {span}"))
    within = Window.partitionBy("entity", "_range").orderBy("page")
    firsts = ranged.groupBy("entity", "_range").agg(F.min("page").alias("_first"))
    over_ranges = Window.partitionBy("entity").orderBy("_range")
    following = firsts.select("entity", "_range", F.lead("_first").over(over_ranges).alias("_following"))
    # AQE broadcasts `following`: one row per ten thousand pages.
    joined = ranged.withColumn("_next", F.lead("page").over(within)).join(following, ["entity", "_range"], "left")
    next_page = F.coalesce("_next", "_following")
    return joined.select(
        "entity",
        "page",
        "n_rows",
        (F.col("n_rows") == page_size).alias("has_more"),
        next_page.alias("next_page"),
        F.coalesce(next_page > F.col("page") + 1, F.lit(False)).alias("gap_after"),
    )


def progress_of_pages(sizes: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """(entity, last_page, completed) as seen from the landed pages."""
    last = F.max_by(F.struct("page", "n_rows"), F.col("page"))
    return sizes.groupBy("entity").agg(last.alias("l")).select(
        "entity", F.col("l.page").alias("last_page"), (F.col("l.n_rows") < page_size).alias("completed")
    )


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Batches one after another; columns a batch lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
