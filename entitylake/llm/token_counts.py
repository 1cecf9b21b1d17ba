"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows of an Arrow batch are dealt to encoding batches of about ``batch_bytes`` each, and a text longer than that is
cut at safe boundaries, so that neither many short nor one very long text makes a batch large.

Defined cases: a null text is empty and has no tokens; null ids and repeated rows are kept; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common, token_pieces


def lengths(texts: Iterable[str], path: str, batch_bytes: int) -> np.ndarray:
    encode, owner = token_pieces.encoder(path), []

    def parts() -> Iterator[str]:
        for row, text in enumerate(texts):
            for part in token_pieces.safe_parts(text, batch_bytes):
                owner.append(row)
                yield part

    counts = [encode.lengths(run) for run in token_pieces.by_bytes(parts(), batch_bytes)]
    return np.bincount(owner, np.concatenate(counts)).astype(np.int64) if counts else np.zeros(0, np.int64)


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 1024,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """Per document its id, n_bytes, n_tokens and whether it has more than ``limit`` tokens."""
    path = token_pieces.tokenizer_path(tokenizer)
    common.ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(lengths(token_pieces.texts_of(batch.column("text")), path, batch_bytes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), n], ["id", "n_bytes", "n"])

    text = common.whole_text(text_column)
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    counted = rows.mapInArrow(count, "id long, n_bytes long, n long")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit")
    )
