"""Connected components of an edge table, by alternating large and small stars.

Before every turn each task replaces edges that lie together, ``AT_ONCE`` at most, by stars of their own, so that a
table of one part needs no turn and others need few: a turn costs the driver several plans, whatever the rows. Neither
raises the least neighbour of a node, and where turns don't lower one any more there are stars only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common, trie_join

#: Edges that a task holds.
AT_ONCE = 1 << 20


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges u, v as stars: u is tied to the least node that edges of the same lot lead to."""

    def stars(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in lot]) for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = trie_join.Forest(len(nodes))
        forest.link(at[: len(u)], at[len(u) :])
        tied = np.flatnonzero(forest.label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[forest.label[tied]])], ["u", "v"])

    lot: list[pa.RecordBatch] = []
    for batch in batches:
        lot.append(batch)
        if sum(b.num_rows for b in lot) >= AT_ONCE:
            yield stars(lot)
            lot = []
    if lot:
        yield stars(lot)


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u").filter("v > u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are tied to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """No node is tied twice, and none that others are tied to is tied itself."""
    ends = edges.selectExpr("stack(2, u, 1, 0, v, 0, 1) as (node, tied, hub)")
    nodes = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("hub").alias("hub"))
    return nodes.filter("tied > 1 or tied = 1 and hub = 1").isEmpty()


def labels(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, component: for every node of an edge but the least of its component, that least node."""
    common.ship(edges.sparkSession)
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    now = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held = common.Scratch(edges.sparkSession)
    now = held.stored(now.mapInArrow(_together, "u long, v long"), "edges")
    while not _stars(now):
        before, held = held, common.Scratch(edges.sparkSession)
        now = held.stored(_small(_large(now)).mapInArrow(_together, "u long, v long"), "edges")
        before.clear()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
