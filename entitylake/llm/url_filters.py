"""URL filters by a sort-merge range join.

A rule names a host and a path prefix; it fits that host and its subdomains where the path starts with the
rule's. Hosts become reversed keys (``a.example.net`` is ``net.example.a.``), so that a rule's host covers one
interval of keys and the intervals of any two rules are nested or apart. URLs and rules are dealt to ranges of
keys, a rule to every range that its interval meets; each range is sorted once and swept with a stack of the
rules whose interval is open. The fitting rule with the longest text wins, among equals the one with the longer
host, then an allowing one.

Ranges are cut at quantiles of a bounded sample of keys (``sample_keys``); the cuts only balance the tasks and
reach below the host into path and id, so that a host with a third of all rows is split too.

Defined cases: a URL that is null or has no ``://`` has an empty host and path; no rule has an empty host, so it
gets the default. Null ids are kept; repeated rows are judged each; an empty table gives no rows. Columns of the
input other than id and URL are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LAST = "\U0010ffff"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(name: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def _cuts(keyed: DataFrame, ranges: int, sample_keys: int) -> list[str]:
    sample = sorted(r.at for r in common.least(keyed.select("at"), common.hash60(F.col("at")), sample_keys).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


FOUND = "id long, host string, path string, rule string, verdict string"
KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    current = None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if row["range"] != current:
                stack, current = [], row["range"]
            while stack and not row["key"].startswith(stack[-1][0]):
                stack.pop()
            if row["kind"] == 0:
                if not stack or stack[-1][0] != row["key"]:
                    stack.append((row["key"], []))
                stack[-1][1].append((row["host"], row["path"], row["verdict"]))
                continue
            fitting = [r for _, level in stack for r in level if row["path"].startswith(r[1])]
            best = max(fitting, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "allow"), default=None)
            rule, verdict = (best[0] + best[1], best[2]) if best else (None, default)
            found.append((row["id"], row["host"], row["path"], rule, verdict))
        columns = zip(*found, strict=True) if found else [()] * len(KINDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], ["id", "host", "path", "rule", "verdict"]
        )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
    ranges: int | None = None,
    sample_keys: int = 10_000,
) -> DataFrame:
    """Per page its id, host, path, the winning rule and the verdict. ``rules``: host, path, verdict."""
    spark = pages.sparkSession
    common.ship(spark)
    ranges = ranges or common.partitions(spark)
    url = F.col(url_column)
    urls = pages.select(F.col(id_column).cast("long").alias("id"), host(url).alias("host"), path(url).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    salt = F.lpad(F.hex(F.xxhash64("id")), 16, "0")
    urls = urls.withColumn("at", F.concat("key", F.lit("/"), "path", F.lit("#"), salt))
    cuts = _cuts(urls, ranges, sample_keys)

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return at.map(lambda x: bisect_right(cuts, x)).astype("int32")

    rules = rules.filter(F.col("host") != "").select(
        F.lit(None).cast("long").alias("id"), "host", F.coalesce("path", F.lit("")).alias("path"), "verdict",
        host_key(F.col("host")).alias("key"),
    )
    reach = F.sequence(range_of(F.col("key")), range_of(F.concat("key", F.lit(LAST))))
    columns = ("range", "key", F.col("kind"), "path", "id", "host", "verdict")
    opened = rules.withColumn("range", F.explode(reach)).withColumn("kind", F.lit(0)).select(*columns)
    swept = urls.withColumns({"range": range_of(F.col("at")), "kind": F.lit(1), "verdict": F.lit(None).cast("string")})
    both = opened.unionByName(swept.select(*columns)).repartition(ranges, "range")
    return both.sortWithinPartitions("range", "key", "kind").mapInArrow(lambda batches: _sweep(batches, default), FOUND)
