"""A multiway hyperplane tree over vectors, in the manner of GNAT, for exact searches by windows of inner products.

A vector x gets one more coordinate, sqrt(M - x.x) for M the greatest x.x, so that all lie on a sphere; a query gets
a zero there, so inner products stay what they are. On the sphere the angle is a metric, and a window of inner
products with a query is an annulus of angles around it.

The split points of a node are taken from a sample of bounded size, each far from those before it; a vector belongs
to its nearest one (the hyperplanes between them part the space). Each split point keeps, for every sibling subtree,
the range of its angles to all rows there, gathered over the whole table. Going down, a sibling is eliminated for a
window as soon as some split point's range for it and the angles that the annulus leaves possible have nothing in
common. Rows of leaves that stay are scored exactly, so the tree changes what is read and never what is found.

Leaves are packed into cells of bounded size; a large leaf is spread over several by a hash of its ids. A task meets
one cell with one block of queries and returns ``k`` rows per window at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common

#: Added to both ends of a window's annulus, more than arccos is off by.
SLACK = 1e-6


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def angles(dots: np.ndarray, product: np.ndarray | float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.arccos(np.clip(np.nan_to_num(dots / product, nan=1.0), -1.0, 1.0))


@dataclass
class Tree:
    """Split points by node; a child is a node, or a leaf written as -1 - its number."""

    width: int
    square: float  # M
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    ranges: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.square - (x * x).sum(axis=1)))[:, None]])

    def grow(self, x: np.ndarray, degree: int, leaf_points: int) -> int:
        """A node or leaf for these lifted sample points."""
        if len(x) > leaf_points:
            picked, nearest = [0], x @ x[0]
            while len(picked) < degree and nearest.min() < self.square * (1 - 1e-9):
                picked.append(int(nearest.argmin()))
                nearest = np.maximum(nearest, x @ x[picked[-1]])
            if len(picked) > 1:
                node, points = len(self.points), x[picked]
                self.points.append(points)
                self.children.append([])
                own = (x @ points.T).argmax(axis=1)
                self.children[node] = [self.grow(x[own == j], degree, leaf_points) for j in range(len(picked))]
                return node
        self.leaves += 1
        return -self.leaves

    def descend(self, x: np.ndarray, tell=None) -> np.ndarray:
        """The leaf of each lifted row. tell(node, angles to all split points, child) is called for every node with rows."""
        leaf = np.zeros(len(x), np.int64)
        waiting = [(0, np.arange(len(x)))] if self.points else []
        while waiting:
            node, rows = waiting.pop()
            dots = x[rows] @ self.points[node].T
            child = dots.argmax(axis=1)
            if tell:
                tell(node, angles(dots, self.square), child)
            for j, below in enumerate(self.children[node]):
                if len(there := rows[child == j]):
                    if below < 0:
                        leaf[there] = -1 - below
                    else:
                        waiting.append((below, there))
        return leaf

    def reach(self, queries: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether window w, inner products low..high with the query ``of`` it, may have rows in a leaf: (windows, leaves)."""
        out = np.zeros((len(of), max(1, self.leaves)), bool)
        if not self.points:
            out[:] = True
            return out
        q = np.hstack([queries.astype(float), np.zeros((len(queries), 1))])
        length = np.sqrt((q * q).sum(axis=1))
        product = length[of] * np.sqrt(self.square)
        near, far = angles(high, product) - SLACK, angles(low, product) + SLACK
        odd = product == 0
        near[odd], far[odd] = 0.0, np.pi
        waiting = [(0, np.arange(len(of)))]
        while waiting:
            node, w = waiting.pop()
            to = angles(q @ self.points[node].T, (length * np.sqrt(self.square))[:, None])[of[w]]  # (windows, split points)
            least = np.maximum(to - far[w, None], near[w, None] - to)
            most = np.minimum(to + far[w, None], 2 * np.pi - to - near[w, None]) + SLACK
            lo, hi = self.ranges[node]
            for j, below in enumerate(self.children[node]):
                stay = w[((least <= hi[:, j]) & (most >= lo[:, j]) | odd[w, None] & (lo[:, j] <= hi[:, j])).all(axis=1)]
                if len(stay):
                    if below < 0:
                        out[stay, -1 - below] = True
                    else:
                        waiting.append((below, stay))
        return out


@dataclass
class Index:
    """All rows (id, label, v, leaf) written by leaf, the tree with its ranges, and the sample it was grown from."""

    rows: DataFrame
    tree: Tree
    sample_ids: np.ndarray
    sample_labels: np.ndarray
    sample: np.ndarray
    first: np.ndarray  # of each leaf its first cell
    cells: np.ndarray  # and in how many it is


def build(rows: DataFrame, sample_rows: int = 4096, degree: int = 16, leaf_points: int = 32, cell_rows: int = 16_384) -> Index:
    """Indexes every row of (id long, label long, v array<long>), none of them null. ``sample_rows`` bounds what the split points are taken from."""
    common.ship(rows.sparkSession)
    rows = common.stored(rows.select("id", "label", "v"), "gnat-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    width, square = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    width, square = max(1, width or 0), float(square or 0.0)
    picked = common.least(rows, common.hash60(F.col("id")), sample_rows).collect()
    sample = np.zeros((len(picked), width), np.int64)
    for i, r in enumerate(picked):
        sample[i, : len(r.v)] = r.v
    tree = Tree(width, square)
    if square > 0:
        tree.grow(tree.lifted(sample), degree, leaf_points)
        if not tree.points:
            tree.leaves = 0
    sizes = [p.shape[0] for p in tree.points]
    starts = np.concatenate([[0], np.cumsum([s * s for s in sizes])]).astype(int)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(starts[-1], np.inf), np.full(starts[-1], -np.inf)

        def tell(node: int, found: np.ndarray, child: np.ndarray) -> None:
            part = slice(starts[node], starts[node + 1])
            least, most = (a[part].reshape(sizes[node], sizes[node]) for a in (lo, hi))
            for j in np.unique(child):
                own = found[child == j]
                least[:, j] = np.minimum(least[:, j], own.min(axis=0))
                most[:, j] = np.maximum(most[:, j], own.max(axis=0))

        for batch in batches:
            leaf = tree.descend(tree.lifted(matrix(batch.column("v"), width)), tell)
            nothing = pa.nulls(batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), nothing, nothing], ["id", "label", "v", "leaf", "lo", "hi"])
        # The last row of a task has its ranges.
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([lo]), pa.array([hi])], ["id", "label", "v", "leaf", "lo", "hi"])

    made = rows.mapInArrow(assign, "id long, label long, v array<long>, leaf int, lo array<double>, hi array<double>")
    made = common.stored(made, "gnat-leaves")
    told = made.filter("leaf is null").select(F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "r"))
    lo, hi = np.full(starts[-1], np.inf), np.full(starts[-1], -np.inf)
    # One row per pair of split points of a node, whatever the table's size.
    for r in told.groupBy("at").agg(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi")).collect():
        lo[r["at"]], hi[r["at"]] = r["lo"], r["hi"]
    tree.ranges = [tuple(a[starts[i] : starts[i + 1]].reshape(s, s) for a in (lo, hi)) for i, s in enumerate(sizes)]
    made = made.filter("leaf is not null").select("id", "label", "v", "leaf")
    counts = np.zeros(max(1, tree.leaves), np.int64)
    for r in made.groupBy("leaf").count().collect():  # as many as the sample has leaves
        counts[r["leaf"]] = r["count"]
    first, cells, cell, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, cell_rows
    for leaf, n in enumerate(counts):
        if n > room and room < cell_rows:
            cell, room = cell + 1, cell_rows
        first[leaf], cells[leaf] = cell, max(1, -(-int(n) // cell_rows))
        cell, room = (cell + int(cells[leaf]), cell_rows) if cells[leaf] > 1 else (cell, room - int(n))
    ids, labels = (np.array([getattr(r, c) for r in picked], np.int64) for c in ("id", "label"))
    return Index(made, tree, ids, labels, sample, first, cells)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x times y transposed, exactly: by 64-bit floats while no sum passes 2^53, by Python's integers beyond."""
    reach = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if reach < 1 << 53:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x.astype(object) @ y.astype(object).T


def best_in(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores that fit, ties to the smaller id."""
    at = np.flatnonzero(fits)
    if len(at) > 4 * k and scores.dtype != object:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return np.array(sorted(at, key=lambda i: (-int(scores[i]), int(ids[i])))[:k], np.int64)


QUERY = "q long, id long, label long, v array<long>, window array<int>, low array<long>, high array<long>"


def search(index: Index, queries: DataFrame, same: bool, k: int, query_rows: int = 4096) -> DataFrame:
    """q, window, id, score: rows of ``QUERY`` asked for the k best rows of each window, low <= 100 * score <= high.

    same: whether a row must have the query's label, or another one. Rows with the query's id are left out.
    """
    tree, width, first, cells = index.tree, index.tree.width, index.first, index.cells
    ids, labels, sample = index.sample_ids, index.sample_labels, index.sample
    asked = queries.count()
    chunks = max(1, -(-asked // query_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            low, high, window = (batch.column(c).to_pylist() for c in ("low", "high", "window"))
            own_label, own_id = batch.column("label").to_numpy(), batch.column("id").to_numpy()
            scores = _exact(v, sample)
            of, lows, highs = [], [], []
            for i, (lo, hi) in enumerate(zip(low, high, strict=True)):
                other = ((labels == own_label[i]) == same) & (ids != own_id[i])
                for w in range(len(lo)):
                    # The k-th best of the sample is a bound that the k-th best of all rows reaches.
                    fit = other & (100 * scores[i] >= lo[w]) & (100 * scores[i] <= hi[w])
                    if fit.sum() >= k:
                        lo[w] = max(lo[w], 100 * int(np.sort(scores[i][fit])[-k]))
                    of.append(i)
                    lows.append(lo[w] / 100)
                    highs.append(hi[w] / 100)
            reach = tree.reach(v, np.array(of, np.int64), np.array(lows), np.array(highs))
            out = []
            at = 0
            for i, lo in enumerate(low):
                leaves = reach[at : at + len(lo)]
                at += len(lo)
                by_cell: dict[int, list[int]] = {}
                for leaf in np.flatnonzero(leaves.any(axis=0)):
                    for c in range(int(first[leaf]), int(first[leaf] + cells[leaf])):
                        by_cell.setdefault(c, []).append(int(leaf))
                out += [(i, c, found, window[i], lo) for c, found in by_cell.items()]
            rows, cell, leaf, windows, lo = zip(*out, strict=True) if out else ((),) * 5
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(taken.column(c) for c in ("q", "id", "label", "v")), pa.array(cell, pa.int64()), pa.array(leaf, pa.list_(pa.int32())),
                 pa.array(windows, pa.list_(pa.int32())), pa.array(lo, pa.list_(pa.int64())), taken.column("high")],
                ["q", "id", "label", "v", "cell", "leaves", "window", "low", "high"],
            )

    routed = queries.mapInArrow(route, "q long, id long, label long, v array<long>, cell long, leaves array<int>, window array<int>, low array<long>, high array<long>")
    routed = routed.withColumn("chunk", F.pmod("q", F.lit(chunks)).cast("int")).withColumn("leaf", F.lit(None).cast("int"))
    # A leaf's first cell and number of cells, as one literal of bounded size.
    of = lambda numbers: F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("leaf") + 1).cast("long")
    rows = index.rows.withColumn("cell", of(first) + F.pmod(F.xxhash64("id"), of(cells)))
    rows = rows.select("id", "label", "v", "leaf", "cell", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def meet(group: pa.Table) -> pa.Table:
        asks = pa.compute.is_null(group.column("leaf"))
        asking, there = group.filter(asks), group.filter(pa.compute.invert(asks))
        out: dict[str, list] = {"q": [], "window": [], "id": [], "score": []}
        if asking.num_rows and there.num_rows:
            x, leaf = matrix(there.column("v"), width), there.column("leaf").to_numpy()
            row_ids, row_labels = there.column("id").to_numpy(), there.column("label").to_numpy()
            v = matrix(asking.column("v"), width)
            for i, r in enumerate(asking.drop_columns(["v"]).to_pylist()):
                open_ = np.flatnonzero(np.isin(leaf, r["leaves"]) & ((row_labels == r["label"]) == same) & (row_ids != r["id"]))
                scores = _exact(x[open_], v[i : i + 1])[:, 0]
                for w, lo, hi in zip(r["window"], r["low"], r["high"], strict=True):
                    best = best_in(scores, row_ids[open_], (100 * scores >= lo) & (100 * scores <= hi), k)
                    out["q"] += [r["q"]] * len(best)
                    out["window"] += [w] * len(best)
                    out["id"] += row_ids[open_][best].tolist()
                    out["score"] += [int(s) for s in scores[best]]
        return pa.table({n: pa.array(c, pa.int32() if n == "window" else pa.int64()) for n, c in out.items()})

    columns = ["id", "label", "v", "leaf", "cell", "chunk", "q", "leaves", "window", "low", "high"]
    void = {"q": "long", "leaves": "array<int>", "window": "array<int>", "low": "array<long>", "high": "array<long>"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in void.items()}).select(*columns)
    met = rows.unionByName(routed.select(*columns)).groupBy("cell", "chunk").applyInArrow(meet, "q long, window int, id long, score long")
    return met
