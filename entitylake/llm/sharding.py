"""Sharding by extendible hashing, in DataFrame operations alone.

A document's key is hashed to 60 bits. The directory starts with one bucket; a bucket over the byte limit splits
on the next bit of the hash, and only such buckets split, until every shard fits. Bytes are summed by a prefix of
``step`` bits in one pass; shards are the shortest prefixes whose sum fits. Where a prefix of that length is still
over the limit, its rows are summed again by the next ``step`` bits, until nothing is over or bits are used up.

Defined cases: a null text has 0 bytes. Keys are the id and a digest of the text, so copies with other ids
spread; rows that agree in both can't be told apart by any bit, and a document over the limit can't be divided:
their shard ends at ``MAX_BITS`` bits, alone with what shares all bits, and is marked ``oversized``. Null ids are
hashed like any other value. An empty table gives no rows. Columns keep their names whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common

MAX_BITS = 60


def _bits(h: Column, n: int) -> Column:
    """The first n bits of the hash, as text."""
    return F.substring(F.lpad(F.bin(h), MAX_BITS, "0"), 1, n)


def _levels(leaves: DataFrame, start: int, end: int) -> DataFrame:
    """Every leaf once per level above it, with its prefix there."""
    level = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth")
    return leaves.select("*", level).withColumn("prefix", F.expr("substring(leaf, 1, depth)"))


def directory(sizes: DataFrame, limit: int, step: int = 16) -> tuple[DataFrame, list[int]]:
    """The directory over ``sizes`` (h, bytes), and the lengths of its leaves.

    A row per leaf: leaf (a bit prefix), shard (the prefix that holds it), depth, shard_bytes, oversized.
    """
    found, pending, start, ends = [], sizes, 0, []
    while start < MAX_BITS:
        end = min(start + step, MAX_BITS)
        ends.append(end)
        leaves = pending.groupBy(_bits(F.col("h"), end).alias("leaf")).agg(F.sum("bytes").alias("bytes"))
        levels = _levels(common.stored(leaves, "shard-leaves"), start, end)
        nodes = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
        # Sums only shrink from a prefix to a longer one: the shard is the shortest prefix that fits.
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == MAX_BITS)
        shards = levels.select("leaf", "depth", "prefix").join(nodes, ["depth", "prefix"]).groupBy("leaf").agg(
            F.min(F.when(fits, F.struct("depth", "prefix", "shard_bytes"))).alias("s")
        )
        shards = common.stored(shards.select("leaf", "s.*"), "shards")
        found.append(shards.filter("depth is not null"))
        over = shards.filter("depth is null").select(F.col("leaf").alias("over"))
        if over.isEmpty():
            break
        pending = pending.join(over, _bits(F.col("h"), end) == F.col("over"), "left_semi")
        start = end
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.withColumnRenamed("prefix", "shard").withColumn("oversized", F.col("shard_bytes") > limit), ends


def shard(docs: DataFrame, limit: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text", step: int = 16) -> DataFrame:
    """The input's columns as ``row``, with n_bytes, shard (a bit prefix), depth, shard_bytes and oversized."""
    text = common.whole_text(text_column)
    keyed = docs.select(
        F.struct("*").alias("row"),
        common.hash60(F.col(id_column), F.md5(text)).alias("h"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    sizes = common.stored(keyed.select("h", F.col("n_bytes").alias("bytes")), "shard-sizes")
    shards, ends = directory(sizes, limit, step)
    # One try where one pass was enough; else a row is looked up at the leaf length of each pass.
    tries = [_bits(F.col("h"), end) for end in ends]
    leaf = tries[0] if len(tries) == 1 else F.explode(F.array(*tries))
    return keyed.withColumn("leaf", leaf).join(shards, "leaf").select("row", "n_bytes", "shard", "depth", "shard_bytes", "oversized")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard below ``path``, as Parquet."""
    sharded.repartition("shard").select("shard", "row.*").write.partitionBy("shard").parquet(path)
