"""Token counts, token files and packing against the tokenizers library itself."""

import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entitylake.llm import packing, token_counts, token_output, token_pieces, wavelet

PATH = token_pieces.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_pieces_give_the_library_ids(library):
    r = random.Random(1)
    marks = ["a", "bc", "the", "é", "1", ".", "'", "'s", "!!", "\n", "\n\n", " ", "  ", "\t", "\u0301", "²", "漢", "😀"]
    marks += ["<|endoftext|>", "<|", "|>", "\r\n", "\x1c", "\x85", "\u180e", "a.\nb", "é!\n", "x\n\ny", "Dž"]
    own = token_pieces.PieceEncoder(PATH, max_pieces=500)
    for _ in range(40):
        texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 30))) for _ in range(50)]
        wanted = [list(ids_of(library, t)) for t in texts]
        assert [list(x) for x in own.encode(texts)] == wanted
        assert list(own.lengths(texts)) == [len(w) for w in wanted]
        for text, ids in zip(texts, wanted, strict=True):
            parts = list(token_pieces.safe_parts(text, r.randint(1, 9)))
            assert "".join(parts) == text and sum(len(ids_of(library, p)) for p in parts) == len(ids)


def test_pieces_of_other_scripts_and_blanks(library):
    r = random.Random(3)
    marks = ["x", "Ab", "ß", "×", "÷", "д", "中", "。", "‘", "’s", "'", "'ll", "'S", "7", "٣", "-", "_", "\x00", "\x7f", "\n", "\n", " "]
    marks += ["\xa0", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000", "\u200b", "\x1f", "\r", "<|endoftext|>", "endoftext|>"]
    own = token_pieces.PieceEncoder(PATH, max_pieces=2000)
    for _ in range(60):
        texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 25))) for _ in range(80)]
        assert [list(x) for x in own.encode(texts)] == [list(ids_of(library, t)) for t in texts]
    assert [list(x) for x in own.encode(["", ""])] == [[], []] and list(own.lengths(["", "a", ""])) == [0, 1, 0]


def test_a_word_is_learned_once_whatever_follows(library):
    """Not once for every mark, number or line that it stands before."""
    words = [f"{a}o{b}e" for a in "bcdfgk" for b in "lmnrst"]
    ends = [",", ".", "!!", "...", ";", "?", ":", ")", "7", "12", ".\n", "!\n"]
    texts = [f"the {w}{e}{v} end" for w in words for v in words[:5] for e in ends]
    own = token_pieces.PieceEncoder(PATH)
    assert [list(x) for x in own.encode(texts)] == [list(ids_of(library, t)) for t in texts]
    assert len(own.known) < 2 * len(words) + len(ends) + 10


def test_frequent_pieces_stay_known(library):
    own = token_pieces.PieceEncoder(PATH, max_pieces=100)
    often = "these words are met again and again"
    for i in range(40):
        texts = [often, " ".join(f"q{'abcdefghij'[i % 10]}{'klmnopqrst'[j]}{'uvwxy'[i // 10]}" for j in range(10))]
        before = set(own.known)
        assert [list(x) for x in own.encode(texts)] == [list(ids_of(library, t)) for t in texts]
        assert len(own.known) <= 100 + 20 and (i < 2 or " again" in before)


def test_counts(documents, texts, library):
    df = token_counts.count_tokens(documents(list(enumerate(texts)) + [(None, "x y"), (0, None)]), batch_bytes=2000)
    found = sorted(tuple(r) for r in df.filter("doc_id is not null").collect())
    wanted = [(i, len((t or "").encode()), len(ids_of(library, t)), len(ids_of(library, t)) > 1024) for i, t in enumerate(texts)]
    assert found == sorted([*wanted, (0, 0, 0, False)])
    assert df.filter("doc_id is null").collect() == [(None, 3, 2, False)]
    assert token_counts.count_tokens(documents([])).collect() == []


def test_wavelet_matrix_is_the_array():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 513, 4000):
        ids = r.integers(0, 70_000 if n == 513 else 300, n).astype(np.uint32)
        cut = n // 3
        keys, lengths, matrix = wavelet.read(wavelet.write([7, None, -1], [ids[:cut], ids[cut:cut], ids[cut:]]))
        assert keys == [7, None, -1] and list(lengths) == [cut, 0, n - cut] and (matrix.all() == ids).all()
        for i in range(0, n, 37):
            assert matrix.access(i) == ids[i]
            assert matrix.count(int(ids[i]), i // 2, n) == (ids[i // 2 :] == ids[i]).sum()
        for value in (0, 5, 299, 1 << 20):
            places = np.flatnonzero(ids == value)
            assert [matrix.find(value, k) for k in range(len(places) + 1)] == [*places, -1]
    with pytest.raises(ValueError):
        wavelet.read(b"none")


def test_token_files_round_trip(documents, texts, library):
    rows = list(enumerate(texts))
    files = token_output.write_files(documents(rows + [(None, "x"), (3, "again")], 4), shard_tokens=5000)
    assert files.count() > 5
    found = sorted((r.start, r.n_tokens, r.id, bytes(r.ids)) for r in token_output.read_files(files).collect())
    start = 0
    order = sorted([*rows, (3, "again")], key=lambda x: (x[0], x[1] or ""))
    for (at, n, key, ids), (wanted_key, text) in zip(found, [(None, "x"), *order], strict=True):
        wanted = np.append(ids_of(library, text), 0).astype("<u4").tobytes()
        assert (at, n, key, ids) == (start, len(wanted) // 4, wanted_key, wanted)
        start += n
    assert token_output.read_files(token_output.write_files(documents([]))).collect() == []


def test_packing(documents, texts, library):
    docs = documents([*enumerate(texts), (3, "again"), (None, "x")])
    pieces = packing.pieces(docs)
    placed = packing.place(pieces)
    rows = placed.collect()
    by_doc, bins = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 1024
        by_doc.setdefault(r.id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        if i == 3:
            continue
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert b"".join(r.ids for r in own) == np.append(ids_of(library, text), 2).astype("<u4").tobytes()
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert all(r.length == 1024 for r in own[1:])
    for own in bins.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    assert whole == {s: b"".join(r.ids for r in sorted(own, key=lambda r: r.offset)) for s, own in bins.items()}
    assert {r.c for r in placed.select(F.crc32("ids").alias("c")).collect()} == {crc32(r.ids) for r in rows}
    assert packing.place(packing.pieces(documents([]))).collect() == []


def test_plan_is_near_the_bound():
    r = np.random.default_rng(0)
    for lengths in (r.integers(1, 1025, 4000), r.integers(1, 400, 4000), np.full(50, 600), np.array([1024, 1])):
        histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        used, bins = {}, 0
        for combination, times in packing.plan(histogram, 1024):
            assert sum(k * n for k, n in combination.items()) <= 1024
            bins += times
            for k, n in combination.items():
                used[k] = used.get(k, 0) + n * times
        assert used == histogram
        bound = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
        assert bins <= bound * 1.02 + 1


def test_fullest_is_the_largest_sum():
    r = random.Random(2)
    for _ in range(60):
        counts = {r.randint(1, 40): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        room = r.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert all(chosen.count(k) <= counts[k] for k in set(chosen))
