"""Exact top-k search by inner product: no-random-access aggregation over blocks.

Every dimension is a list of the candidates' shares of the score. The ends of a list, its least and greatest value,
bound what a candidate can still get from it. A query reads its lists one after another, the ones that weigh most
first, each to its end, and keeps a running sum per candidate. What the unread lists can add at least and at most
gives every candidate's lower and upper score bound. Candidates whose upper bound is below the k-th lower bound are
dropped after every few lists, and reading stops as soon as hardly more than k are left: outsiders can't qualify any
more. Only for these the other lists are looked up, which resolves their final scores.

A stated set of queries meets all candidates in blocks: candidates and queries are dealt by a hash of their id
to blocks of bounded size, and each pair of blocks is one task that returns k rows per query at most. The rows
of a query are then merged by rank.

Components are integers and all scores exact: 64-bit floats while no sum can pass 2^53, Python's integers beyond.
Defined cases: a vector that is null or holds a null or non-finite component takes no part; an empty vector
scores 0; of two lengths the shorter one is filled with zeros. Ties go to the smaller id. Rows with a null id
take no part; repeated ids are candidates each, and none is a candidate of its own id. An empty table gives no
rows. Very long vectors are read whole, a block of them at a time. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm import common

#: Lists read between two looks at the bounds, and the part of the lists before the first look.
STEP, FIRST = 2, 0.75


def integer_components(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(embedding, lambda x: F.floor(x.cast("double") * float(scale))))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    lengths = np.diff(ends)
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths)] = lists.values.to_numpy()[ends[0] : ends[-1]]
    return out


class Lists:
    """A block of candidates by dimension, with the ends of every list."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, reach: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.n = ids[by_id], len(ids)
        #: Floats are exact while no sum can pass 2^53; beyond, Python's integers are.
        most = reach * int(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
        self.kind = np.float64 if most < 1 << 53 else object
        self.values = np.ascontiguousarray(vectors[by_id].T).astype(self.kind)
        self.least, self.greatest = self.values.min(axis=1), self.values.max(axis=1)


def aggregate(lists: Lists, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of a query's k best candidates, best first, their scores, and how many lists were read for all that were left."""
    weight = query.astype(lists.kind)
    order = np.argsort(-np.abs(query), kind="stable")
    ends = np.stack([weight * lists.least, weight * lists.greatest])[:, order]
    # What lists from a place on can add, at least and at most.
    none = np.zeros(1, lists.kind)
    low, high = (np.concatenate([np.cumsum(e[::-1])[::-1], none]) for e in (ends.min(axis=0), ends.max(axis=0)))
    alive = np.flatnonzero(lists.ids != query_id)
    whole = len(alive) == lists.n
    total = np.zeros(len(alive), lists.kind)
    read, look = 0, max(1, math.ceil(FIRST * len(order)))
    while read < len(order) and len(alive) > k:
        for d in order[read:look]:
            values = lists.values[d]
            total += weight[d] * (values if whole else values[alive])
        read, look = look, min(look + STEP, len(order))
        kth = np.partition(total, len(total) - k)[len(total) - k] if lists.kind is np.float64 else sorted(total)[-k]
        stay = np.flatnonzero(total + high[read] >= kth + low[read])
        if len(stay) < len(alive):
            alive, total, whole = alive[stay], total[stay], False
        if len(alive) <= 2 * k:
            break
    for d in order[read:]:
        total = total + weight[d] * lists.values[d][alive]
    best = np.lexsort((alive, -total))[:k] if lists.kind is np.float64 else np.array(sorted(range(len(alive)), key=lambda i: (-total[i], i))[:k], int)
    return alive[best], total[best], read


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 64,
    block_rows: int = 16_384,
    query_rows: int = 8_192,
) -> DataFrame:
    """query_id, rank, id and score of each query's k best candidates, its own id left out."""
    part = integer_components(F.col(vector_column), scale)
    common.ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), part.alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    total, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, chunks = max(1, -(-total // block_rows)), max(1, -(-asked // query_rows))
    hashed = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "v", F.lit(False).alias("asks"), F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), every(chunks).alias("chunk"))
    queries = rows.filter("q").select("id", "v", F.lit(True).alias("asks"), every(blocks).alias("block"), F.pmod(hashed, F.lit(chunks)).cast("int").alias("chunk"))

    def meet(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        width = max((len(v) for v in group.column("v")), default=0)
        ids, v = group.column("id").to_numpy(), _matrix(group.column("v"), max(1, width))
        out = {"query_id": [], "id": [], "score": []}
        if asks.any() and not asks.all():
            lists = Lists(v[~asks], ids[~asks], int(np.abs(v[asks]).max(initial=0)))
            for q, query in zip(ids[asks], v[asks], strict=True):
                at, scores, _ = aggregate(lists, query, q, k)
                out["query_id"] += [int(q)] * len(at)
                out["id"] += [int(lists.ids[int(i)]) for i in at]
                out["score"] += [int(s) for s in scores]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in out.items()})

    near = candidates.unionByName(queries).groupBy("block", "chunk").applyInArrow(meet, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_column), "score")
