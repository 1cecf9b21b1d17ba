"""SimHash near-duplicates: fingerprints within a Hamming budget, joined by binary tries.

Fingerprints are made in one pass over whole texts. A node is a fingerprint, whatever ids have it, so copies never
meet as pairs and an id that several documents share links nothing. To spread the trie, the 64 bits are cut into ``blocks`` parts: two fingerprints with
at most ``budget`` differing bits agree in some ``blocks - budget`` parts entirely, so for each choice of parts
the nodes that agree there form a bucket, and in one of the buckets every pair is found. A bucket is joined with
itself by a trie walk that keeps components only, and gives at most one link per node. Components of all links
are found by alternating stars over written edge tables.

With 6 parts and 4 bits, a node is in 15 buckets that share 21 bits or more; more ``blocks`` give smaller buckets.

Defined cases: a null text has no words; without words a fingerprint is zero and is linked like any other. Fewer
words than a shingle form one shingle. Repeated ids are documents each. A document with a null id is linked like
any other; the component of documents that all have none is null. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common, components, trie_join

SEED = 42
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = 4) -> bytes:
    """The 64 bits, first bit first."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split()  # of bytes: only A-Z change, and exactly the six separators split
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = starts[: len(last)].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in zip(first[part], last[part], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(last)).tobytes()


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """Per document its id, the digest of its text, and its fingerprint as a signed number."""
    common.ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = b"".join(fingerprint(t.as_py(), shingle) for t in batch.column("text"))
            fp = np.frombuffer(bits, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(fp)], ["id", "digest", "fp"])

    rows = docs.select(*common.row_key(id_column, text_column), common.whole_text(text_column).alias("text"))
    return rows.mapInArrow(of, "id long, digest long, fp long")


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of the sorted rows, cut between buckets only."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(n).to_numpy() for n in names]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        change = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
        cut = change[-1] + 1 if len(change) else 0
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None:
        yield held


def _masks(blocks: int, budget: int) -> list[int]:
    """The bits that two fingerprints share, for each choice of parts that may be equal."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(parts, blocks - budget)]


def links(nodes: DataFrame, budget: int = 4, blocks: int = 6) -> DataFrame:
    """Links a, b that join all nodes (fp, n) within the budget to components."""
    common.ship(nodes.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for choice, key, fp, n in _runs(batches, ["choice", "key", "fp", "n"]):
            new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.empty(0, bool)
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(key)))
            keep = np.flatnonzero(np.repeat(size > 1, size))
            if not len(keep):
                continue
            size = size[size > 1]
            starts = np.cumsum(size) - size
            fp, n = fp[keep].view(np.uint64), n[keep]
            # Signed order has the upper half first; the trie needs the order of the bits.
            order = np.lexsort((fp, np.repeat(np.arange(len(size)), size)))
            fp, n = fp[order], n[order]
            label = trie_join.components(fp, starts, n, budget)
            linked = np.flatnonzero(label != np.arange(len(label)))
            node = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["a", "b"])

    tries = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(blocks, budget))]
    buckets = nodes.select("fp", "n", F.explode(F.array(*tries)).alias("t")).select("t.*", "fp", "n")
    buckets = buckets.repartition(common.partitions(nodes.sparkSession), "choice", "key").sortWithinPartitions("choice", "key")
    return buckets.mapInArrow(walk, "a long, b long")


def _labelled(docs: DataFrame, id_column: str, text_column: str, shingle: int, budget: int, blocks: int) -> DataFrame:
    """Per document id, digest, fp, part (the least fingerprint that links lead to) and component_id."""
    made = common.stored(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    nodes = made.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    nodes = common.stored(nodes, "fingerprint-nodes")
    found = components.labels(links(nodes, budget, blocks), "a", "b")
    of = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("part"))
    least = of.groupBy("part").agg(F.min("id").alias("component_id"))
    of = of.join(least, "part").select("fp", "part", "component_id")
    # A fingerprint may hold a third of all documents; its single row here meets them in parts that adaptive execution splits.
    return made.join(of, "fp")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, budget: int = 4, blocks: int = 6
) -> DataFrame:
    """Per document its id, fingerprint (hexadecimal) and component_id, the least id that links lead to."""
    return _labelled(docs, id_column, text_column, shingle, budget, blocks).select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, budget: int = 4, blocks: int = 6
) -> DataFrame:
    """One document of each component, the one with the least id, with all columns; see ``common.one_per_part``."""
    made = _labelled(docs, id_column, text_column, shingle, budget, blocks)
    return common.one_per_part(docs, made, id_column, text_column)
