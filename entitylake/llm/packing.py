"""Best-fit packing of documents into sequences by minimum bin slack.

Texts are encoded once, ended by ``end_id`` and written as pieces; only documents over the capacity are cut, into
full pieces after a first one that takes the remainder. Packing needs no more than the number of pieces of each
length, at most ``capacity`` numbers: for one bin after another, a bitset subset-sum over the lengths still there
finds the fullest combination with the largest of them, which is removed as many times as it is there. Pieces of
equal length are interchangeable, so a piece's place follows from its length and its rank in that length.

Ranks need no sort: a piece has a running number in its task and length, and the counts of tasks before it are
added. Those counts are one row per task and length. The plan has at most a few rows per length, whatever the
number of pieces: a combination is repeated until one of its lengths is used up.

Defined cases: a null or empty text is one piece, the end id alone. Null ids, repeated ids and repeated rows are
documents each. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm import common, token_pieces

PIECES = "id long, piece int, start long, length long, ids binary, part int, place long"
SPAN = 1 << 44


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what doesn't fill a piece."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    docs: DataFrame,
    capacity: int = 1024,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """The pieces of all documents, written: ids are 32-bit little-endian, place counts equal lengths in a task."""
    common.ship(docs.sparkSession)
    path = token_pieces.tokenizer_path(tokenizer)
    end = np.array([end_id], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            keys, at = batch.column("id").to_pylist(), 0
            for run in token_pieces.by_bytes(token_pieces.texts_of(batch.column("text")), batch_bytes):
                rows = []
                for key, ids in zip(keys[at : at + len(run)], token_pieces.encoder(path).encode(run), strict=True):
                    data = np.concatenate([ids, end]).astype("<u4").tobytes()
                    for number, (start, length) in enumerate(cut(len(ids) + 1, capacity)):
                        rows.append((key, number, start, length, data[4 * start : 4 * (start + length)], part, met[length]))
                        met[length] += 1
                at += len(run)
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                names = ["id", "piece", "start", "length", "ids", "part", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), common.whole_text(text_column).alias("text"))
    return common.stored(rows.mapInArrow(encode, PIECES), "pieces")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, repeats included, with the largest sum of at most ``room`` that ``counts`` allows.

    One or two pieces that fill the room are preferred, so that short pieces are left for bins that need them.
    """
    if room in counts:
        return [room]
    for length in sorted(counts, reverse=True):
        other = room - length
        if other in counts and (other != length or counts[length] > 1):
            return [length, other]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        copies = min(counts[length], room // length) if length else 0
        take = 1
        while copies > 0:
            take = min(take, copies)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            copies -= take
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Combinations of lengths, and how many bins each one fills."""
    left = {length: n for length, n in histogram.items() if n}
    out = []
    while left:
        largest = max(left)
        rest = {length: n - (length == largest) for length, n in left.items()}
        combination = Counter([largest, *fullest({k: n for k, n in rest.items() if n}, capacity - largest)])
        times = min(left[length] // used for length, used in combination.items())
        out.append((combination, times))
        for length, used in combination.items():
            left[length] -= used * times
            if not left[length]:
                del left[length]
    return out


def _slots(combinations: list[tuple[Counter, int]]) -> np.ndarray:
    """Rows (length, first rank, used per bin, first bin, first offset), ordered by length and rank."""
    ranks, rows, bins = Counter(), [], 0
    for combination, times in combinations:
        offset = 0
        for length, used in sorted(combination.items(), reverse=True):
            rows.append((length, ranks[length], used, bins, offset))
            ranks[length] += used * times
            offset += used * length
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """``rows`` of pieces (part, place and length among their columns) with sequence_id and offset."""
    counts = common.stored(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n"))  # at most one row per length
    slots = _slots(plan({r.length: r.n for r in histogram.collect()}, capacity))
    keys = slots[:, 0] * SPAN + slots[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        own = slots[np.searchsorted(keys, length.to_numpy() * SPAN + rank.to_numpy(), "right") - 1]
        ahead = rank.to_numpy() - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 3] + ahead // own[:, 2], "offset": own[:, 4] + ahead % own[:, 2] * own[:, 0]})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(bases, ["part", "length"]).withColumn("s", slot("length", F.col("base") + F.col("place")))
    return ranked.select(*[c for c in rows.columns if c not in ("part", "place")], "s.sequence_id", "s.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """Each sequence's ids, in order of offset. ``placed``: pieces with ids, placed."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(ordered, F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    return placed.groupBy("sequence_id").agg(ids.alias("ids"))
