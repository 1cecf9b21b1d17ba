"""Token ids of whole documents in files of their own format, one wavelet matrix per shard.

Documents are dealt to ranges of ascending id and encoded in order; a shard closes at ``shard_tokens`` ids or
more, so that a task holds one shard at a time and a document never spans two. The files are the ``file`` column
of a table in the shared folder, which any store that Spark writes to can hold. Reading them back, a document's
start is the count of ids in the ranges before its own, in the shards before, and in the shard so far; the first
two come from one row per shard and need no pass over ids.

Defined cases: a null or empty text is the end id alone. Null ids come first. Rows of equal id are ordered by
text, equal rows either way give the same file. An empty table gives no files. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm import common, token_pieces, wavelet

FILES = "part int, shard int, n_docs long, n_tokens long, file binary"


def write_files(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_tokens: int = 1 << 18,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """One row per file: part and shard in ascending order of ids, counts, and the file's bytes."""
    spark = docs.sparkSession
    common.ship(spark)
    path = token_pieces.tokenizer_path(tokenizer)
    end = np.array([end_id], np.uint32)

    def file(part: int, shard: int, keys: list, found: list) -> pa.RecordBatch:
        row = (part, shard, len(keys), sum(map(len, found)), wavelet.write(keys, found))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "shard", "n_docs", "n_tokens", "file"]
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        found: list[np.ndarray] = []
        for batch in batches:
            at, own = 0, batch.column("id").to_pylist()
            for run in token_pieces.by_bytes(token_pieces.texts_of(batch.column("text")), batch_bytes):
                for ids in token_pieces.encoder(path).encode(run):
                    keys.append(own[at])
                    found.append(np.concatenate([ids, end]))
                    held += len(ids) + 1
                    at += 1
                    if held >= shard_tokens:
                        yield file(part, shard, keys, found)
                        keys, found, shard, held = [], [], shard + 1, 0
        if keys:
            yield file(part, shard, keys, found)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), common.whole_text(text_column).alias("text"))
    ranges = rows.repartitionByRange(common.partitions(spark), "id").sortWithinPartitions("id", "text")
    return common.stored(ranges.mapInArrow(encode, FILES), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """Per document of the files: id, start, n_tokens and its ids (32-bit, little-endian)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("file"), strict=True):
                keys, lengths, matrix = wavelet.read(data.as_py())
                ids = matrix.all().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                spans = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths), pa.array(spans, pa.binary())],
                    ["id", "start", "n_tokens", "ids"],
                )

    counts = files.select("part", "shard", "n_tokens")
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.join(parts, "part").select(
        "part", "shard", (F.col("part_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base")
    )
    bases = common.stored(bases, "token-bases")
    return files.join(bases, ["part", "shard"]).select("base", "file").mapInArrow(
        decode, "id long, start long, n_tokens long, ids binary"
    )
