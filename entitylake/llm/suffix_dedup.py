"""Suffix-array dedup of long repeats: a depth-limited radix sort, most significant digit first.

A suffix matters only through its first ``threshold`` bytes. Suffixes are not all moved: those that share an
anchor (see ``repeats``) are sorted as one run as long as nothing tells them apart. Each pass groups what is left
by the next digit. In a group with one content, its first place holds the original and every other place repeats
it; a group with several contents goes on to the next pass. After the last digit a group is one window, so equal
groups are exactly the repeated windows.

1. Runs by anchor, over all texts.
2. Of runs in groups with several contents, one representative each, by the bytes that a range of offsets shares.
3. Of ranges in such groups, their windows.

Only the least id of each content is kept from a pass, so the result for a document is found from what is first in
it: what isn't, starts earlier elsewhere. Contents are combined before they are shuffled, a content that a third of
all documents holds is one row per task. Texts meet what is first in them by id; no group of texts is ever built.
Passes are written to the shared folder. Contents are compared by 64-bit hashes inside groups of equal digits.

Defined cases: a null text is empty. Texts shorter than the threshold have no repeats. A null id is the largest.
Rows of equal id stand at the same place: what only they share is original in each. An empty table gives no rows.
Columns keep their names whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm import common, repeats
from entitylake.llm.repeats import Depth, Digits

BUFFER_BYTES = 1 << 18
ROWS = "digit long, content long, doc long"


def _buffers(texts: list[bytes]) -> Iterator[tuple[slice, bytes, np.ndarray, np.ndarray]]:
    """Texts in buffers of about BUFFER_BYTES: which ones, the buffer, and where they start in it and how long."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= BUFFER_BYTES:
            size += len(texts[end])
            end += 1
        lengths = np.fromiter(map(len, texts[at:end]), np.int64, end - at)
        yield slice(at, end), b"\0".join(texts[at:end]), np.cumsum(lengths + 1) - lengths - 1, lengths
        at = end


def _rows(digit: list[np.ndarray], content: list[np.ndarray], doc: list[np.ndarray]) -> pa.RecordBatch:
    """The least doc of each content: what is equal in a batch is combined before it is shuffled."""
    digits, contents, docs = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((digit, np.uint64), (content, np.uint64), (doc, np.int64)))
    order = np.argsort(docs, kind="stable")
    first = order[np.unique(contents[order], return_index=True)[1]]
    columns = (digits[first].view(np.int64), contents[first].view(np.int64), docs[first])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["digit", "content", "doc"])


def _firsts(rows: DataFrame, name: str) -> DataFrame:
    """Per content its least doc, and whether others share its digit."""
    n = common.partitions(rows.sparkSession)
    least = rows.repartition(n, "digit").groupBy("digit", "content").agg(F.min("doc").alias("doc"))
    group = Window.partitionBy("digit")
    several = F.min("content").over(group) != F.max("content").over(group)
    return common.stored(least.select("doc", "content", several.alias("several")), name)


def _told(rows: DataFrame, told: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function`` over rows (doc, at, text, rest) that come after what is told of their doc, both by doc."""
    rest = rows.schema["rest"].dataType
    right = rows.select("doc", F.lit(True).alias("is_text"), F.lit(None).cast("long").alias("content"), F.lit(False).alias("several"), "at", "text", "rest")
    left = told.select(
        "doc", F.lit(False).alias("is_text"), "content", "several", F.lit(None).cast("long").alias("at"),
        F.lit(None).cast("binary").alias("text"), F.lit(None).cast(rest).alias("rest"),
    )
    both = left.unionByName(right).repartition(common.partitions(rows.sparkSession), "doc")
    return both.sortWithinPartitions("doc", "is_text", "at").mapInArrow(lambda batches: _chunks(batches, function), schema)


def _chunks(batches: Iterator[pa.RecordBatch], function: Callable) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    last_doc = None
    for batch in batches:
        doc = batch.column("doc").to_numpy()
        is_text = batch.column("is_text").to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(~is_text)
        content = batch.column("content").take(pa.array(mine)).to_numpy().view(np.uint64)
        held.append((doc[mine], content, batch.column("several").to_numpy(zero_copy_only=False)[mine]))
        texts = np.flatnonzero(is_text)
        if len(texts):
            told = Told(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield function(told, batch.take(pa.array(texts)))
            # A later row of the last doc may come in the next batch.
            last_doc = doc[texts[-1]]
            held = [tuple(c[told.doc >= last_doc] for c in (told.doc, told.content, told.several))]


class Told:
    """Contents whose first place is in a doc."""

    def __init__(self, doc: np.ndarray, content: np.ndarray, several: np.ndarray):
        self.doc, self.content, self.several = doc, content, several
        keys = repeats.mixed(doc, content)
        order = np.argsort(keys)
        self.keys, self.marks = keys[order], several[order]

    def of(self, doc: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each content is first in its doc, and if so, whether it has to be told from others."""
        if not len(self.keys):
            return np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        keys = repeats.mixed(doc, content)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, known & self.marks[at]


def _once(text: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Marks the first place of each content in its text; places are in order."""
    out = np.zeros(len(content), bool)
    out[np.unique(repeats.mixed(text, content), return_index=True)[1]] = True
    return out


def _first_pass(docs: DataFrame, depth: Depth) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("doc").to_numpy(), ([], [], [])
            for part, data, starts, lengths in _buffers(batch.column("text").to_pylist()):
                digits = Digits(data, depth)
                r = repeats.runs(digits, starts, lengths)
                for column, x in zip(found, (*repeats.first_digit(digits, r), ids[part][r.text]), strict=True):
                    column.append(x)
            yield _rows(*found)

    return docs.select("doc", "text").mapInArrow(emit, ROWS)


def _representatives(docs: DataFrame, firsts: DataFrame, depth: Depth) -> DataFrame:
    """The bytes of runs that are first of their content and share their digit with others."""

    def pick(told: Told, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = rows.column("doc").to_numpy(), ([], [], [], [])
        for part, data, starts, lengths in _buffers(rows.column("text").to_pylist()):
            digits = Digits(data, depth)
            r = repeats.runs(digits, starts, lengths)
            _, content = repeats.first_digit(digits, r)
            _, several = told.of(ids[part][r.text], content)
            r = r.take(np.flatnonzero(several & _once(r.text, content)))
            low, high = r.anchor - r.first, r.anchor - r.last + depth.threshold
            out[0].append(ids[part][r.text])
            out[1].append(r.first)
            out[2].append(r.last)
            out[3].extend(data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True))
        columns = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in out[:3]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(out[3], pa.binary())], ["doc", "first", "last", "text"])

    several = firsts.filter("several")
    return common.stored(_told(docs, several, pick, "doc long, first long, last long, text binary"), "repeat-runs")


def _stored_runs(rows: pa.RecordBatch, depth: Depth) -> Iterator[tuple[slice, Digits, repeats.Runs]]:
    first, last = rows.column("first").to_numpy(), rows.column("last").to_numpy()
    for part, data, starts, _ in _buffers(rows.column("text").to_pylist()):
        yield part, Digits(data, depth), repeats.Runs(starts + first[part], first[part], last[part], np.arange(len(starts)))


def _second_pass(runs: DataFrame, depth: Depth) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("doc").to_numpy(), ([], [], [])
            for part, digits, r in _stored_runs(batch, depth):
                ranges, _, digit, content = repeats.second_digit(digits, r)
                for column, x in zip(found, (digit, content, ids[part][ranges.text]), strict=True):
                    column.append(x)
            yield _rows(*found)

    return runs.mapInArrow(emit, ROWS)


def _last_pass(runs: DataFrame, firsts: DataFrame, depth: Depth) -> DataFrame:
    def emit(told: Told, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = rows.column("doc").to_numpy(), ([], [], [])
        flat = pa.RecordBatch.from_arrays(
            [rows.column("text"), *rows.column("rest").flatten()], ["text", *[f.name for f in rows.column("rest").type]]
        )
        for part, digits, r in _stored_runs(flat, depth):
            ranges, _, _, content = repeats.second_digit(digits, r)
            _, several = told.of(ids[part][ranges.text], content)
            ranges = ranges.take(np.flatnonzero(several))
            _, of, window = repeats.last_digit(digits, ranges)
            for column, x in zip(found, (window, window, ids[part][ranges.text][of]), strict=True):
                column.append(x)
        return _rows(*found)

    rows = runs.select("doc", F.lit(0).cast("long").alias("at"), "text", F.struct("first", "last").alias("rest"))
    return _told(rows, firsts.filter("several"), emit, ROWS)


def _repeated(digits: Digits, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, told: Told) -> np.ndarray:
    """Marks the bytes of a buffer that a window which isn't first covers."""
    threshold = digits.depth.threshold
    change = np.zeros(digits.n + 1, np.int32)

    def cover(r: repeats.Runs) -> None:
        np.add.at(change, r.anchor - r.first, 1)
        np.add.at(change, r.anchor - r.last + threshold, -1)

    def sort_out(r: repeats.Runs, content: np.ndarray) -> repeats.Runs:
        first, several = told.of(ids[r.text], content)
        once = _once(r.text, content)
        cover(r.take(np.flatnonzero(~(first & once))))
        return r.take(np.flatnonzero(several & once))

    r = repeats.runs(digits, starts, lengths)
    r = sort_out(r, repeats.first_digit(digits, r)[1])
    ranges, _, _, content = repeats.second_digit(digits, r)
    ranges = sort_out(ranges, content)
    at, of, content = repeats.last_digit(digits, ranges)
    zero = np.zeros(len(at), np.int64)
    sort_out(repeats.Runs(at, zero, zero, ranges.text[of]), content)
    return np.cumsum(change[:-1]) > 0


def _remove(docs: DataFrame, told: DataFrame, depth: Depth, as_text: bool) -> DataFrame:
    def cut(told: Told, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, kept = rows.column("doc").to_numpy(), []
        sizes: list[np.ndarray] = []
        removed: list[np.ndarray] = []
        spans: list[np.ndarray] = []
        texts = rows.column("text").to_pylist()
        for part, data, starts, lengths in _buffers(texts):
            gone = _repeated(Digits(data, depth), starts, lengths, ids[part], told) if len(data) else np.zeros(0, bool)
            # Buffers have a byte between texts that is never covered, so runs end with their text.
            total = np.concatenate([[0], np.cumsum(gone)])
            rising = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])
            sizes.append(lengths)
            removed.append(total[starts + lengths] - total[starts])
            spans.append(rising[starts + lengths] - rising[starts])
            array = np.frombuffer(data, np.uint8)
            for text, start, length, n in zip(texts[part], starts.tolist(), lengths.tolist(), removed[-1].tolist(), strict=True):
                kept.append(text if not n else array[start : start + length][~gone[start : start + length]].tobytes())
        if as_text:
            kept = [x.decode("utf-8", "ignore") for x in kept]
        kind = pa.string() if as_text else pa.binary()
        numbers = [pa.array(np.concatenate(x)) for x in (sizes, removed, spans)]
        return pa.RecordBatch.from_arrays(
            [rows.column("rest"), pa.array(kept, kind), *numbers], ["rest", "kept", "n_bytes", "n_removed", "n_spans"]
        )

    rest = docs.schema["rest"].dataType.simpleString()
    schema = "rest " + rest + f", kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long"
    return _told(docs, told, cut, schema)


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", depth: Depth | None = None, as_text: bool = False) -> DataFrame:
    """Per document its other columns as ``rest``, the bytes kept, and counts of bytes, removed bytes and removed runs.

    ``as_text`` gives what is kept as text; what is left of a character that was cut in two then goes.
    """
    common.ship(docs.sparkSession)
    depth = depth or Depth()
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_column])
    largest = F.lit((1 << 63) - 1)
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("long"), largest).alias("doc"), F.lit(0).cast("long").alias("at"),
        common.whole_text(text_column).cast("binary").alias("text"), rest.alias("rest"),
    )
    first = _firsts(_first_pass(rows, depth), "repeat-first")
    slim = rows.select("doc", "at", "text", F.struct(F.lit(0).alias("none")).alias("rest"))
    runs = _representatives(slim, first, depth)
    second = _firsts(_second_pass(runs, depth), "repeat-second")
    last = _last_pass(runs, second, depth).groupBy("content").agg(F.min("doc").alias("doc"))
    last = common.stored(last.select("doc", "content", F.lit(False).alias("several")), "repeat-last")
    return _remove(rows, first.unionByName(second).unionByName(last), depth, as_text)
