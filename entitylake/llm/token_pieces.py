"""Token ids of whole texts by a public tokenizer, each distinct piece of text encoded once.

A byte-level BPE splits a text by a pattern before any merge. Texts are cut at places that no match of the pattern
crosses and where the matches beside it stay what they are: between a character that is no white space and a space
or line feed after it, after a line feed that stands alone, and where Latin letters, ASCII digits and ASCII marks
meet, but for a letter after an apostrophe. Special strings are not cut: the library treats them as it does by
default. The places are found over the bytes of many texts at once, equal pieces of these texts are looked up once,
and only pieces not met before go through the tokenizers library.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

# What a byte is to the pattern. SOLID ends a character beyond ASCII that is neither white space nor a Latin-1 letter;
# OTHER bytes have no safe place beside them.
OTHER, BLANK, FEED, LETTER, DIGIT, MARK, APOSTROPHE, SOLID = range(8)


def _kinds() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[0x21:0x7F] = MARK
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[0x80:0xC0] = SOLID
    out[[0x20, 0x0A, 0x27]] = BLANK, FEED, APOSTROPHE
    return out


def _safe() -> np.ndarray:
    """By 8 * kind of the byte before + kind of the byte after; not those after a line feed."""
    out = np.zeros((8, 8), bool)
    solid = [LETTER, DIGIT, MARK, APOSTROPHE]
    out[np.ix_([*solid, SOLID], [BLANK, FEED])] = True
    for a in solid:
        out[a, [b for b in solid if a != b]] = True
    out[MARK, APOSTROPHE] = out[APOSTROPHE, MARK] = out[APOSTROPHE, LETTER] = False
    return out.ravel()


KINDS, SAFE = _kinds(), _safe()
# White space beyond ASCII, by its first byte.
SPACES = {c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))}
LEADS = {lead: [s for s in SPACES if s[0] == lead] for lead in {s[0] for s in SPACES}}

# Fixed value: how a byte-level vocabulary writes a space.
SPACE = "\u0120"
WORDS_AT_ONCE = 500

_encoders: dict[str, PieceEncoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> PieceEncoder:
    """One per worker process, so that pieces stay known from batch to batch."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def safe_places(data: np.ndarray, special: list[bytes]) -> np.ndarray:
    """For every byte of UTF-8 texts, one after another, whether it is safe to cut before it."""
    kinds = KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]  # multiplication and division sign
    kinds[lead] = kinds[lead + 1] = LETTER
    for byte, spaces in LEADS.items():
        lead = np.flatnonzero(data == byte)
        for space in spaces if len(lead) else ():
            end = len(space) - 1
            at = lead[(data[lead + 1] == space[1]) & (data[lead + end] == space[end])]
            kinds[at + end] = OTHER
    out = np.zeros(len(data), bool)
    out[1:] = SAFE[8 * kinds[:-1] + kinds[1:]]
    feed = np.flatnonzero(kinds[1:-1] == FEED) + 1
    alone = (kinds[feed - 1] >= LETTER) & (kinds[feed + 1] >= LETTER) & (kinds[feed + 1] != SOLID)
    out[feed[alone] + 1] = True
    whole = data.tobytes() if special else b""
    for own in special:
        at = whole.find(own)
        while at >= 0:
            out[at + 1 : at + len(own)] = False
            at = whole.find(own, at + 1)
    return out


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """The texts of an Arrow column, few at a time as Python strings."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def by_bytes(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def safe_parts(text: str, limit: int) -> Iterator[str]:
    """The text in parts of ``limit`` characters or more, each but the first starting with a space at a safe place."""
    start = 0
    while len(text) - start > limit:
        at = start + limit
        while (at := text.find(" ", at)) > 0 and text[at - 1].isspace():
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


class _Numbers(dict):
    """Numbers pieces as they are asked for; ``new`` has those that were not known."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class PieceEncoder:
    """Pieces met but once are forgotten when more than ``max_pieces`` are known; results don't depend on it."""

    def __init__(self, path: str, max_pieces: int = 600_000, max_chars: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.max_pieces, self.max_chars = max_pieces, max_chars
        self._empty()

    def _empty(self) -> None:
        self.known, self.chars, self.used = _Numbers(), 0, 0
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts, self.sizes, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keeps the pieces that were met again in other texts, if they are few enough."""
        own, again = list(self.known), np.flatnonzero(self.met[: len(self.known)] > 1)
        sizes, (ids, _) = self.sizes[again], self._ids(again)
        self._empty()
        kept = [own[i] for i in again]
        if 2 * len(kept) <= self.max_pieces and 2 * sum(map(len, kept)) <= self.max_chars:
            self.known.update(zip(kept, range(len(kept)), strict=True))
            self.chars = sum(map(len, kept))
            self._append(list(range(len(kept))), sizes, ids)
            self.met[: len(kept)] = 1

    def _append(self, numbers: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        while len(self.known) > len(self.starts):
            old = (self.starts, self.sizes, self.met)
            self.starts, self.sizes, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in old)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        """Ids of the pieces that have a number only."""
        new = self.known.new
        self.chars += sum(map(len, new))
        first = len(self.known) - len(new)
        words, lone, others = [], [], []
        for i, piece in enumerate(new):
            spaced = piece[0] == " "
            if spaced and piece[1:].isalpha():
                words.append(i)
            elif len(own := piece.split()) == 1 and len(piece) == len(own[0]) + spaced:
                lone.append(i)
            else:
                others.append(i)
        for numbers, encode in ((words, self._encode_words), (lone, self._encode_lines), (others, self._encode_each)):
            if numbers:
                self._append([first + i for i in numbers], *encode([new[i] for i in numbers]))
        self.known.new = []

    def _encode_each(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum())

    def _encode_runs(self, own: list[str], between: str) -> np.ndarray:
        runs = [between.join(own[at : at + WORDS_AT_ONCE]) for at in range(0, len(own), WORDS_AT_ONCE)]
        found = self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
        return np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)

    def _encode_words(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words at once: each begins at its space, so at the one token of it that begins with a space."""
        ids = self._encode_runs(own, "")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(own):  # of a tokenizer that doesn't mark spaces so
            return self._encode_each(own)
        return np.diff(starts, append=len(ids)), ids

    def _encode_lines(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces without white space, but for a space ahead, at once: a line feed after each is a token of its own."""
        if len(self.feed) != 1:
            return self._encode_each(own)
        ids = self._encode_runs([piece + "\n" for piece in own], "")
        feeds = ids == self.feed[0]
        ends = np.flatnonzero(feeds)
        if len(ends) != len(own):
            return self._encode_each(own)
        return np.diff(ends, prepend=-1) - 1, ids[~feeds]

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and where each piece's end."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(total)], ends

    def _look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every piece, and where each text's pieces end."""
        if len(self.known) > self.max_pieces or self.chars > self.max_chars:
            self._forget()
        column = pa.array(texts, pa.string())
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32, len(texts) + 1) if texts else np.zeros(1, np.int32)
        if not ends[-1]:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        safe = safe_places(np.frombuffer(data, np.uint8, ends[-1]), self.special)
        safe[ends[ends < ends[-1]]] = True
        starts = np.flatnonzero(safe)
        places = pa.py_buffer(np.append(starts, ends[-1]).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, places, data]).dictionary_encode()
        own = pieces.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        if self.known.new:
            self._learn()
        self.met[numbers] += 1
        return numbers[pieces.indices.to_numpy()], np.searchsorted(starts, ends[1:])

    def lengths(self, texts: list[str]) -> np.ndarray:
        numbers, ends = self._look_up(texts)
        total = np.concatenate([[0], np.cumsum(self.sizes[numbers])])
        return np.diff(total[ends], prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        numbers, piece_ends = self._look_up(texts)
        flat, ends = self._ids(numbers)
        ends = np.concatenate([[0], ends])
        return np.split(flat, ends[piece_ends][:-1])
