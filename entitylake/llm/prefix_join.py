"""Grouped prefix join: documents whose sets of word shingles are similar (Jaccard), exactly.

All shingles have one order, rare ones first. Two sets of the wanted similarity share a shingle of their prefixes,
the first n - ceil(n * percent / 100) + 1 shingles of each. Equal sets are one node, nodes of equal prefix and size
one group, and a group is one entry in the list of every shingle of its prefix. Pairs of groups in a list are
filtered by size, by what their places in the prefix leave possible, and by parity bitmaps; what passes is expanded
to members. A bitmap of fixed size tells nothing of large sets, so pairs of members are filtered once more by sketches, bitmaps
that grow with their set; every link is decided by the whole sets. Sets are made again for nodes with a partner that passes.

Only components are asked for, so pairs inside one component are not looked at. First every list ties its members
to its most typical member (by one order of all groups, so that a family has few hubs), then to another one picked by
hash; a group is compared with one of its lists' hubs. Then
all pairs of a list that are still in different components are looked at, so no link between components is missed.
Lists are rows of a join, which adaptive execution splits; no list meets in one task. A pair that the filters refuse
is never a row. Many sets of one list that are just short of similar cost a comparison of bitmaps per pair.

The order by rarity comes from a table of counts of all shingles, of fixed size (``shingle_sets``): any order gives the same links,
a better one gives shorter lists.

Defined cases: null and empty texts and texts without words have the empty set, which is linked with nothing. Fewer
words than a shingle are one shingle. Equal texts and repeated rows are one node. Repeated ids are documents each,
and a component's id is the least id in it; a document with a null id is linked like any other, and a component
of null ids alone has a null id. An empty table gives no rows. Very long texts are read whole; a worker holds the
numbers of one text. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm import common, components, shingle_sets

#: Longs of a parity bitmap.
WORDS = 8
BITMAP = [f"w{i}" for i in range(WORDS)]
#: Sets of more elements have a sketch besides: bitmaps of unlike ones differ in about half their bits whatever the size.
WIDE = 64 * WORDS


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def bitmap(numbers: np.ndarray) -> np.ndarray:
    """Parities of the counts of numbers in 64 * WORDS bits. Two sets differ in as many elements at least as bitmaps in bits."""
    bits = np.bincount((numbers >> np.uint64(40)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def nodes_of(docs: DataFrame, shingle: int, percent: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document id, digest of its text, node (null without words), n, group, prefix and bitmap."""
    spark = docs.sparkSession
    common.ship(spark)
    text = common.whole_text(text_column)
    order = shingle_sets.frequencies(docs, text, shingle)
    order = np.minimum(order, np.iinfo(np.uint32).max).astype(np.uint32)
    names = ["id", "digest", "node", "n", "gid", "prefix", "sketch", *BITMAP]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, gid, prefix, sketches, words = [], [], [], [], [], []
            for t in batch.column("text"):
                numbers = shingle_sets.shingles(t.as_py(), shingle)
                n.append(len(numbers))
                by_rarity = np.argsort(order[shingle_sets.bucket(numbers)], kind="stable")
                first = numbers[by_rarity[: prefix_length(len(numbers), percent)]] if len(numbers) else numbers
                node.append(shingle_sets.digest(numbers) if len(numbers) else None)
                gid.append(shingle_sets.digest(first, len(numbers)) if len(numbers) else None)
                prefix.append(first.view(np.int64))
                sketches.append(shingle_sets.sketch(numbers, WIDE))
                words.append(bitmap(numbers))
            bits = np.array(words, np.int64).reshape(-1, WORDS).T
            made = [pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(gid, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *made, *map(pa.array, bits)], names)

    schema = f"id long, digest long, node long, n long, gid long, prefix array<long>, sketch binary, {', '.join(f'{w} long' for w in BITMAP)}"
    rows = docs.select(*common.row_key(id_column, text_column), text.alias("text"))
    return common.stored(rows.mapInArrow(of, schema), "shingle-nodes")


def _possible(percent: int, x: str = "x", y: str = "y") -> str:
    """SQL: sizes allow the similarity."""
    return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"


def _shared(percent: int, x: str = "x", y: str = "y") -> str:
    """SQL: how many elements two sets of that similarity have in common at least."""
    return f"(({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent})"


def _places(percent: int, x: str = "x", y: str = "y") -> str:
    """SQL: the places of a shared shingle leave enough elements to share: those before it, itself and those behind it."""
    return f"least({x}.pos, {y}.pos) + least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {_shared(percent, x, y)}"


def _near_bits(percent: int, x: str = "x", y: str = "y") -> str:
    """SQL: bitmaps differ in no more bits than sets of that similarity in elements."""
    differ = " + ".join(f"bit_count({x}.{w} ^ {y}.{w})" for w in BITMAP)
    return f"{differ} <= {x}.n + {y}.n - 2 * {_shared(percent, x, y)}"


#: SQL: two groups aren't of one component entirely.
APART = "not (x.low = x.high and y.low = y.high and x.low = y.low)"


class _Join:
    """The tables of one join, and what it found so far: links, and parts as ``components.labels`` has them."""

    def __init__(self, docs: DataFrame, made: DataFrame, shingle: int, percent: int, id_column: str, text_column: str, known: DataFrame | None):
        self.shingle, self.percent, self.spark = shingle, percent, docs.sparkSession
        lists_held, self.held = common.Scratch(self.spark), common.Scratch(self.spark)
        worded = made.filter("n > 0")
        groups = worded.groupBy("gid").agg(
            F.min("n").cast("int").alias("n"), F.first("prefix").alias("prefix"), F.min("node").alias("lo"), F.max("node").alias("hi"),
            *[F.min(w).alias(w) for w in BITMAP],
        )
        groups = lists_held.stored(groups, "shingle-groups")
        entries = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
        lists = entries.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1").select("token")
        entries = lists_held.stored(entries.join(lists, "token").select("token", "gid", "n", "pos"), "shingle-lists")
        # Only entries with a partner that passes all filters go on.
        full = entries.join(groups.select("gid", (F.col("lo") < F.col("hi")).alias("several"), *BITMAP), "gid")
        full = lists_held.stored(full, "shingle-bitmaps")
        bits = f"(x.several or y.several or {_near_bits(percent)})"
        partner = F.expr(f"x.token = y.token and x.gid <> y.gid and {_possible(percent)} and {_places(percent)} and {bits}")
        entries = full.alias("x").join(full.alias("y"), partner, "left_semi")
        # How typical a group is: the share of its set's shingles that bring it to a live list. One order for all lists,
        # so that the lists of a family mostly have the same hub.
        live = F.count("*").over(Window.partitionBy("gid")) / F.col("n")
        self.entries = self.held.stored(entries.select("token", "gid", "n", "pos", live.alias("live")), "shingle-live")
        wanted = self.entries.select("gid").unionByName(groups.filter("lo < hi").select("gid")).distinct()
        row = F.xxhash64("digest", "id").alias("row")
        members = worded.join(wanted, "gid", "left_semi").groupBy("gid", "node").agg(
            F.min("n").cast("int").alias("n"), F.min(row).alias("row"), F.min("sketch").alias("sketch"), *[F.min(w).alias(w) for w in BITMAP]
        )
        self.members = self.held.stored(members, "shingle-members")
        lists_held.clear()
        self.sketches = self.members.select("node", "n", "row", "sketch")
        if known is not None:
            ends = known.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            own = worded.join(ends, "node", "left_semi").select("node", F.col("n").cast("int").alias("n"), row, "sketch")
            made = self.sketches.unionByName(own).groupBy("node").agg(F.min("n").alias("n"), F.min("row").alias("row"), F.min("sketch").alias("sketch"))
            self.sketches = self.held.stored(made, "shingle-sketches")
        texts = docs.select(*common.row_key(id_column, text_column), common.whole_text(text_column).alias("text"))
        self.texts = texts.select(row, "text")
        self.links = self.spark.createDataFrame([], "a long, b long")
        self.parts: DataFrame | None = None
        if known is not None:
            self.check(known)

    def check(self, pairs: DataFrame) -> None:
        """Adds the pairs that are links. Only sets of pairs whose sketches are near are made, and they are deleted after."""
        held = common.Scratch(self.spark)
        near = held.stored(shingle_sets.near(pairs, self.sketches, self.percent), "shingle-near")  # read several times
        if not near.isEmpty():
            ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            nodes = held.stored(self.sketches.select("node", "row").join(ends, "node", "left_semi"), "shingle-ends")
            sets = held.stored(shingle_sets.sets_of(self.texts, self.shingle, nodes), "shingle-sets")
            new = common.stored(shingle_sets.similar(near, sets, self.percent), "shingle-links")
            self.links = self.links.unionByName(new)
            # What was found before is as many rows as it ties nodes; its links needn't be read again.
            known = self.parts
            if known is not None:
                new = new.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
            self.parts = components.labels(new, "a", "b")
            if known is not None:
                common.dropped(known)
        held.clear()

    def _state(self) -> tuple[DataFrame, DataFrame]:
        """Members with their part, and groups with the least and greatest part of theirs."""
        members = self.members.drop("row", "sketch").withColumn("part", F.col("node"))
        if self.parts is not None:
            found = self.parts.withColumnRenamed("node", "of")
            members = self.members.join(found, F.col("node") == F.col("of"), "left").withColumn("part", F.coalesce("component", "node"))
            members = self.held.stored(members.drop("of", "component", "row", "sketch"), "shingle-parts")
        groups = members.groupBy("gid").agg(
            F.min("n").alias("n"), F.count("*").alias("m"), F.min("node").alias("rep"), F.min("part").alias("low"),
            F.max("part").alias("high"), *[F.min(w).alias(w) for w in BITMAP],
        )
        return members, groups

    def _pass(self, pairs: DataFrame, members: DataFrame, one: bool) -> None:
        """Expands pairs of groups (a, b) to members, of a its representative alone if ``one``, and adds their links.

        Hubs stay on the side of a, so that few sets travel there.
        """
        x = members
        if one:
            x = members.groupBy("gid").agg(F.min(F.struct("node", *[c for c in members.columns if c not in ("gid", "node")])).alias("x")).select("gid", "x.*")
        met = pairs.join(x.alias("x"), F.expr("a = x.gid")).join(members.alias("y"), F.expr(f"b = y.gid and x.part <> y.part and {_near_bits(self.percent)}"))
        found = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        self.check(found)

    def run(self, stars: int) -> _Join:
        bits = f"(x.m > 1 or y.m > 1 or {_near_bits(self.percent)})"
        sizes = f"{_possible(self.percent)} and {_places(self.percent)}"
        for turn in range(stars):
            members, groups = self._state()
            rank = F.struct(-F.col("live"), "gid") if turn == 0 else F.struct(F.xxhash64("gid", F.lit(turn)), "gid")
            hubs = self.entries.groupBy("token").agg(F.min_by(F.struct("gid", "n", "pos"), rank).alias("hub")).select("token", "hub.*")
            star = hubs.alias("x").join(self.entries.alias("y"), F.expr(f"x.token = y.token and x.gid <> y.gid and {sizes}"))
            star = star.groupBy(F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).agg(F.count("*").alias("lists"))
            # Bitmaps and parts travel once per pair. Of the hubs that remain, a group is compared with the one that it shares most lists with.
            maps = groups.select("gid", "n", "m", "low", "high", *BITMAP)
            near = star.join(maps.alias("x"), F.expr("a = x.gid")).join(maps.alias("y"), F.expr(f"b = y.gid and {APART} and {bits}"))
            star = near.groupBy("b").agg(F.max_by("a", F.struct("lists", "a")).alias("a")).select("a", "b")
            own = groups.filter("low <> high").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
            self._pass(star.unionByName(own), members, one=True)
        members, groups = self._state()
        entries = self.entries.join(groups.drop("n"), "gid")
        rest = entries.alias("x").join(entries.alias("y"), F.expr(f"x.token = y.token and x.gid < y.gid and {APART} and {sizes} and {bits}"))
        rest = rest.select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"))
        own = groups.filter("low <> high").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
        self._pass(rest.unionByName(own).distinct(), members, one=False)
        self.held.clear()
        return self


def links(
    docs: DataFrame,
    made: DataFrame,
    shingle: int,
    percent: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    stars: int = 2,
    known: DataFrame | None = None,
) -> DataFrame:
    """Links a, b between nodes that join all similar sets to components. made: ``nodes_of`` docs.

    known: pairs of nodes that may be similar, from elsewhere; they are checked first.
    """
    join = _Join(docs, made, shingle, percent, id_column, text_column, known).run(stars)
    if join.parts is not None:
        common.dropped(join.parts)
    return join.links


def parts_of(
    docs: DataFrame,
    made: DataFrame,
    shingle: int,
    percent: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    stars: int = 2,
    known: DataFrame | None = None,
) -> DataFrame:
    """The components of ``links``: node, component for every node but the least of its component, without keeping the links."""
    join = _Join(docs, made, shingle, percent, id_column, text_column, known).run(stars)
    common.dropped(join.links)
    return join.parts if join.parts is not None else join.links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def components_of(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, percent: int = 85
) -> DataFrame:
    """Per document its id, n_shingles and component_id, the least id that links of similar sets lead to."""
    made = nodes_of(docs, shingle, percent, id_column, text_column)
    found = parts_of(docs, made, shingle, percent, id_column, text_column).withColumnRenamed("node", "of")
    nodes = made.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"))
    parts = nodes.join(found, F.col("node") == F.col("of"), "left").select("node", "id", F.coalesce("component", "node").alias("part"))
    least = parts.groupBy("part").agg(F.min("id").alias("component_id"))
    named = parts.join(least, "part").select(F.col("node").alias("of"), "component_id")
    # A set may belong to a third of all documents; its single row meets them in parts that adaptive execution splits.
    worded = made.filter("n > 0").join(named, F.col("node") == F.col("of")).select("id", "n", "component_id")
    rows = worded.unionByName(made.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return rows.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")
