"""Sets of word shingles as sorted 64-bit numbers, and tables of counts of fixed size.

Words are hashed for a whole text at once, by differences of running sums of byte values times powers of an odd
number, modulo 2^64; words of more than ``LONG`` bytes by XXH64. The numbers of shingles are mixed from those of
their words. Equal shingles have equal numbers; two different ones share a number with odds of about 2^-64, and sets
are compared by these numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common

SEED = 42
#: Bytes of a text hashed at once, and of the longest word hashed with others.
CHUNK, LONG = 1 << 17, 256
#: A table of counts has 2^BITS numbers, whatever the input, and travels in blocks of 2^BLOCK_BITS.
BITS, BLOCK_BITS = 20, 12


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    factors = np.full(CHUNK + 1, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BYTES, _FACTORS = (np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed, n in ((SEED, 256), (SEED + 1, 64)))
_BASE = 0x9E3779B97F4A7C15
_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_numbers(text: str) -> np.ndarray:
    """One number per word; A-Z count as a-z."""
    from xxhash import xxh64_intdigest

    data = text.encode().lower()  # of bytes: only A-Z change
    values = np.frombuffer(data, np.uint8)
    outside = np.concatenate([[True], _SPACE[values], [True]])
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    start, end = edges[::2], edges[1::2]
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        first = start[at]
        to = max(at + 1, int(np.searchsorted(end, first + CHUNK, "right")))
        part = values[first : min(end[to - 1], first + CHUNK)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * _POWER[: len(part)], dtype=np.uint64)])
        i, j = (np.minimum(x[at:to] - first, len(part)) for x in (start, end))
        out[at:to] = (sums[j] - sums[i]) * _INVERSE[i]
        at = to
    for k in np.flatnonzero(end - start > LONG):
        out[k] = xxh64_intdigest(data[start[k] : end[k]], SEED)
    return _mixed(out)


def shingle_numbers(text: str, size: int) -> np.ndarray:
    """The numbers of a text's shingles in order, repeats included. Fewer words than ``size`` are one shingle; none are none."""
    words = word_numbers(text)
    if not len(words):
        return words
    run = min(size, len(words))
    made = np.full(len(words) - run + 1, run, np.uint64)
    for i in range(run):
        made += words[i : i + len(made)] * (_FACTORS[i % 64] + np.uint64(2 * (i // 64)))
    return _mixed(made)


def shingles(text: str, size: int) -> np.ndarray:
    """The numbers of a text's different shingles, ascending."""
    return np.unique(shingle_numbers(text, size))


def digest(numbers: np.ndarray, salt: int = 0) -> int:
    from xxhash import xxh64_intdigest

    found = xxh64_intdigest(numbers.tobytes(), SEED + salt)
    return found - (1 << 64) if found >> 63 else found


def sketch(numbers: np.ndarray, least: int) -> bytes | None:
    """Parities of the counts of numbers, in four bits a number up to 2^BITS; none for ``least`` numbers or fewer.

    Longer ones fold to shorter ones, half on half. Two sets differ in as many elements at least as sketches in bits.
    """
    if len(numbers) <= least:
        return None
    bits = min(1 << BITS, 1 << (4 * len(numbers) - 1).bit_length())
    at = (numbers >> np.uint64(64 - BITS)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ."""
    s, t = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(s) != len(t):
        if len(s) < len(t):
            s, t = t, s
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return int(np.bitwise_count(s ^ t).sum(dtype=np.int64))


def bucket(numbers: np.ndarray) -> np.ndarray:
    """Where numbers are counted in a table."""
    return (numbers & np.uint64((1 << BITS) - 1)).astype(np.int64)


def counted(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One task's table of counts, as rows of (block, counts)."""
    total = np.zeros(1 << BITS, np.int64)
    for numbers in parts:
        total += np.bincount(bucket(numbers), minlength=len(total))
    blocks = total.reshape(-1, 1 << BLOCK_BITS)
    used = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[b].tobytes() for b in used], pa.binary())], ["block", "counts"])


COUNTED = "block int, counts binary"


def table_of(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' tables, 2^BITS numbers. A task holds the sums of its blocks and reads one row at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                one = np.frombuffer(counts.as_py(), np.int64)
                sums[block] = sums[block] + one if block in sums else one
        out = [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["block", "counts"])

    dealt = rows.repartition(common.partitions(rows.sparkSession), "block")
    table = np.zeros((1 << BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.int64)
    # At most one row per block: 8 MB however many documents there are.
    for row in dealt.mapInArrow(add, COUNTED).collect():
        table[row.block] = np.frombuffer(row.counts, np.int64)
    return table.ravel()


def frequencies(docs: DataFrame, text: Column, size: int) -> np.ndarray:
    """By bucket of shingles: how often, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(np.concatenate([shingle_numbers(t.as_py(), size) for t in b.column("text")] or [np.empty(0, np.uint64)]) for b in batches)

    return table_of(docs.select(text.alias("text")).mapInArrow(count, COUNTED))


def present(numbers: DataFrame) -> np.ndarray:
    """For a frame with one column of numbers: which buckets hold one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(b.column(0).to_numpy().view(np.uint64) for b in batches)

    return table_of(numbers.mapInArrow(count, COUNTED)) > 0


def sets_of(texts: DataFrame, size: int, nodes: DataFrame) -> DataFrame:
    """node and its set (little-endian numbers) for the given nodes (node, row), row being one with that set. texts: (row, text).

    A table of fixed size keeps most other texts from being looked at, copies too; the join by node decides.
    """
    nodes = nodes.groupBy("node").agg(F.min("row").alias("row"))
    wanted = present(nodes.select("row"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, bytes] = {}
            there = np.flatnonzero(wanted[bucket(batch.column("row").to_numpy().view(np.uint64))])
            for i in there.tolist():
                numbers = shingles(batch.column("text")[i].as_py(), size)
                if len(numbers):
                    found[digest(numbers)] = numbers.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "numbers"])

    made = texts.select("row", "text").mapInArrow(of, "node long, numbers binary")
    return made.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("numbers").alias("numbers"))


def near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sketches (node, n, sketch) differ in no more bits than sets of that similarity in elements."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(batch.column("n").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                most = n - 2 * -(-percent * n // (100 + percent))
                keep.append(not x.is_valid or not y.is_valid or apart(x.as_buffer(), y.as_buffer()) <= most)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sketches.select(F.col("node").alias(e), F.col("n").alias(f"n_{e}"), F.col("sketch").alias(s)) for e, s in (("a", "x"), ("b", "y")))
    met = pairs.join(y, "b").join(x, "a").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "x", "y")
    return met.mapInArrow(of, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose whole sets have at least ``percent`` of their union in common."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def ends(end: str, numbers: str) -> DataFrame:
        # Only sets of these ends; a set that is shuffled for this lies where the next join needs it.
        used = sets.join(pairs.select(F.col(end).alias("node")).distinct(), "node", "left_semi")
        return used.select(F.col("node").alias(end), F.col("numbers").alias(numbers))

    met = pairs.join(ends("b", "y"), "b").join(ends("a", "x"), "a")
    return met.select("a", "b", "x", "y").mapInArrow(of, "a long, b long")
