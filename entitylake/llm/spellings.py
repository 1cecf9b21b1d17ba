"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by PartEnum signatures.

A word is the set of its letters with their occurrence number (the second ``t`` is ``t2``), a binary vector over all
such elements. One edit changes at most two elements: a replaced letter takes one out and puts one in, with the
length unchanged; an inserted or deleted one changes a single element, with the length changed by one. The elements
are dealt by hash to parts. Vectors at distance two or less agree in all but two of ``PARTS`` parts, so words of
equal length are met on every choice of PARTS - 2 parts; words of neighbouring lengths, at distance one, on every
choice of CLOSE - 1 of CLOSE parts. A signature is the digest of a choice with its parts, and the lengths it is
for. Words meet in one equi-join by signature, which adaptive execution splits where a signature is common; what
differs at both ends of the word is refused by two numbers, and the edit distance decides. Only near pairs become rows.

Words are counted in one pass over whole texts, summed in the task before they are shuffled. A word's form is its
nearest more common spelling; forms are followed to the last by doubling the step, over written tables.

Defined cases: a null or empty text has no words; a null id is written ``null`` where a run is corrupted. Repeated
rows and ids are documents each. Ties of two forms go to the smaller word in code-point order. Very long texts are
read whole, batch by batch; a task holds at most ``HELD`` different words before it hands them on. An empty table
gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common

# Fixed value: the letters of a run (A-Z, a-z, and U+00C0 to U+00FF).
RUN = r"[A-Za-zÀ-ÿ]+"
PARTS, CLOSE = 5, 3
HELD = 1 << 18


def corrupted(run: str, document: int | None, every: int) -> str:
    """The run, with one code point deleted if the checksum of document and run says so."""
    h = zlib.crc32(f"{'null' if document is None else document}:{run}".encode())
    return run if h % every else run[: (at := h % len(run))] + run[at + 1 :]


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", every: int = 97) -> DataFrame:
    """word, n: lower-cased (A-Z alone) runs of letters, one of ``every`` corrupted, with their occurrences."""
    common.ship(docs.sparkSession)

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(RUN), Counter()
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                for run, n in Counter(runs.findall(text.as_py().encode().lower().decode())).items():
                    held[corrupted(run, key, every)] += n
                if len(held) > HELD:
                    yield batch_of(held)
                    held.clear()
        yield batch_of(held)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), common.whole_text(text_column).alias("text"))
    return rows.mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def signatures(word: str) -> list[tuple[int, int]]:
    """(length, digest) of a word's signatures: for words of its length, then for those one shorter or longer."""
    from xxhash import xxh64_intdigest

    seen: Counter = Counter()
    far: list[list[str]] = [[] for _ in range(PARTS)]
    close: list[list[str]] = [[] for _ in range(CLOSE)]
    for letter in word:
        seen[letter] += 1
        element = f"{letter}{seen[letter]}"
        h = zlib.crc32(element.encode())
        far[h % PARTS].append(element)
        close[(h >> 8) % CLOSE].append(element)
    out = []
    for parts, differ, lengths in ((far, 2, (2 * len(word),)), (close, 1, (2 * len(word) - 1, 2 * len(word) + 1))):
        texts = ["".join(sorted(p)) for p in parts]
        for choice in combinations(range(len(parts)), len(parts) - differ):
            digest = xxh64_intdigest("|".join([str(choice), *(texts[p] for p in choice)]))
            out += [(length, digest - (1 << 64) if digest >> 63 else digest) for length in lengths]
    return out


def near_pairs(words: DataFrame, letters: int) -> DataFrame:
    """x, y, n_x, n_y: each pair of words (word, n) of ``letters`` or more at edit distance one, once, x before y."""
    common.ship(words.sparkSession)
    end = max(0, letters - 1) // 2
    names = ["word", "n", "length", "digest", "head", "tail"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                # One edit leaves the first or the last ``end`` letters as they are, whichever of the two words has them.
                head, tail = zlib.crc32(word[:end].encode()), zlib.crc32(word[-end:].encode())
                rows += [(word, n, length, digest, head, tail) for length, digest in signatures(word)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    made = words.mapInArrow(of, "word string, n long, length long, digest long, head long, tail long")
    made = common.stored(made, "spelling-signatures")
    met = made.alias("x").join(
        made.alias("y"),
        F.expr(
            "x.digest = y.digest and x.length = y.length and x.word < y.word and (x.head = y.head or x.tail = y.tail)"
            " and levenshtein(x.word, y.word, 1) = 1"
        ),
    )
    return met.select(F.col("x.word").alias("x"), F.col("y.word").alias("y"), F.col("x.n").alias("n_x"), F.col("y.n").alias("n_y")).distinct()


def followed(forms: DataFrame) -> DataFrame:
    """word, root: where the links word, form lead in the end. Links must not go round."""
    now = common.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("of"), F.col("root").alias("next"))
        stepped = now.join(on, F.col("root") == F.col("of"), "left")
        stepped = stepped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = common.stored(stepped, "spelling-roots")
        now = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return now


def group_spellings(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", every: int = 97, letters: int = 5, least: int = 3, ratio: int = 2
) -> DataFrame:
    """Per word of at least ``letters`` code points and ``least`` occurrences: form, root, n, n_near and form_n.

    form: the most common near word, if it occurs at least ``ratio`` times as often (more than once, so that forms
    never go round); root: where forms lead.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could go round")
    words = count_words(docs, id_column, text_column, every).filter((F.col("n") >= least) & (F.length("word") >= letters))
    words = common.stored(words, "spelling-words")
    pairs = near_pairs(words, letters)
    both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("n_y").alias("m")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"), F.col("n_x").alias("m")))).alias("p"))
    near = both.select("p.*").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    found = words.join(near, F.col("word") == F.col("a"), "left")
    takes = -F.col("best.m") >= ratio * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.b")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"),
    )
    found = common.stored(found, "spelling-forms")
    roots = followed(found.filter("form is not null")).withColumnRenamed("word", "of")
    found = found.join(roots, F.col("word") == F.col("of"), "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
