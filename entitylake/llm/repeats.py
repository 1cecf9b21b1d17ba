"""Repeated windows of bytes: the digits by which a radix sort tells windows apart, for many texts at once.

Every window of ``threshold`` bytes has one anchor, the leftmost of its substrings of ``digit`` bytes with the
least hash. Equal windows have equal anchors at equal places, so the anchor is the first digit of the sort.
Neighbouring windows with the same anchor form a run, which is sorted as a whole as long as it can be: a run's
content is equal to another's if their first and last windows are. Runs that share an anchor but not their content
are divided into ranges of offsets to the anchor, whose windows have more bytes in common, the next digit; at the
last, a window stands for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_A, _B = U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15)
#: A 64-bit number for each byte, from a rule.
_BYTES = (np.arange(1, 257, dtype=U) * _B ^ (np.arange(1, 257, dtype=U) * _A >> U(23))) * _A | U(1)


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    x = np.zeros(1, U)
    for part in parts:
        x = (x ^ np.asarray(part).astype(U)) * _B
        x = (x ^ (x >> U(32))) * _A
    return x ^ (x >> U(29))


@dataclass(frozen=True)
class Depth:
    """How deep windows are compared: window length, first digit, and offsets per range of the second digit."""

    threshold: int = 100
    ranges: int = 8

    @property
    def digit(self) -> int:
        return 1 << ((self.threshold // 3).bit_length() - 1)

    @property
    def reach(self) -> int:
        """The largest offset of an anchor in its window."""
        return self.threshold - self.digit

    def spans(self) -> list[tuple[int, int]]:
        """Ranges of offsets, first and last."""
        step = -(-(self.reach + 1) // self.ranges)
        return [(a, min(a + step - 1, self.reach)) for a in range(0, self.reach + 1, step)]


class Digits:
    """Hashes of all substrings of a buffer, by lengths that are powers of two."""

    def __init__(self, data: bytes, depth: Depth):
        self.depth, self.n = depth, len(data)
        # Reads past the end are of positions that no caller uses.
        buffer = np.frombuffer(data + bytes(2 * depth.threshold), np.uint8)
        x, length, self.by_length = _BYTES[buffer], 1, {}
        while True:
            if length >= depth.digit:
                self.by_length[length] = x
            if 2 * length > depth.threshold:
                break
            y = x[:-length] * _A
            y += x[length:]
            y ^= y >> U(31)
            y *= _B
            x, length = y, 2 * length

    def span(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of substrings of one length, by the first and the last power of two in it."""
        p = 1 << (length.bit_length() - 1)
        x = self.by_length[p]
        return mixed(x[at], x[at + (length - p)], length)

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.span(at, self.depth.threshold)

    def anchors(self) -> np.ndarray:
        """Per position the least hash of a first digit in the window that starts there."""
        x, length, wanted = self.by_length[self.depth.digit], 1, self.depth.reach + 1
        while 2 * length <= wanted:
            x = np.minimum(x[:-length], x[length:])
            length *= 2
        return np.minimum(x[: len(x) - (wanted - length)], x[wanted - length :])


@dataclass
class Runs:
    """Runs of windows: the anchor's place, the first window's offset to it and the last one's, and the text."""

    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray

    def take(self, index: np.ndarray) -> Runs:
        return Runs(self.anchor[index], self.first[index], self.last[index], self.text[index])


def runs(digits: Digits, starts: np.ndarray, lengths: np.ndarray) -> Runs:
    """All runs of the texts at ``starts`` in the buffer, in order."""
    windows = np.maximum(0, lengths - digits.depth.threshold + 1)
    total = int(windows.sum())
    text = np.repeat(np.arange(len(starts)), windows)
    at = np.arange(total) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    least = digits.anchors()[at]
    new = np.ones(total, bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    low, high = at[begin], at[np.append(begin[1:], total) - 1] if total else at
    text = text[begin]
    keys, reach = digits.by_length[digits.depth.digit], np.arange(digits.depth.reach + 1)
    done, todo = [], (low, high, text)
    while len(todo[0]):
        low, high, text = todo
        anchor = low + np.argmin(keys[low[:, None] + reach], axis=1)
        done.append((low, np.minimum(high, anchor), anchor, text))
        # Windows beyond an anchor have the next one of the same hash.
        rest = np.flatnonzero(high > anchor)
        todo = (anchor[rest] + 1, high[rest], text[rest])
    if not done:
        empty = np.empty(0, np.int64)
        return Runs(empty, empty, empty, empty)
    low, high, anchor, text = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(low, kind="stable")
    low, high, anchor, text = (x[order] for x in (low, high, anchor, text))
    return Runs(anchor, anchor - low, anchor - high, text)


def first_digit(digits: Digits, r: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Per run the digit it is sorted by, and its content."""
    content = mixed(digits.window(r.anchor - r.first), digits.window(r.anchor - r.last), r.first, r.last)
    return digits.by_length[digits.depth.digit][r.anchor], content


def second_digit(digits: Digits, r: Runs) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of the runs in order, the run each is of, its digit and its content."""
    out = []
    for number, (low, high) in enumerate(digits.depth.spans()):
        first, last = np.minimum(high, r.first), np.maximum(low, r.last)
        of = np.flatnonzero(first >= last)
        own = Runs(r.anchor[of], first[of], last[of], r.text[of])
        shared = digits.span(own.anchor - low, digits.depth.threshold - (high - low))
        content = mixed(digits.window(own.anchor - own.first), digits.window(own.anchor - own.last), own.first, own.last, -1)
        out.append((own.anchor, own.first, own.last, own.text, of, mixed(shared, number), content))
    anchor, first, last, text, of, digit, content = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(anchor - first, kind="stable")
    return Runs(anchor[order], first[order], last[order], text[order]), of[order], digit[order], content[order]


def last_digit(digits: Digits, r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of the ranges in order: its place, the range it is of, and its content."""
    count = r.first - r.last + 1
    of = np.repeat(np.arange(len(count)), count)
    at = (r.anchor - r.first)[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return at, of, mixed(digits.window(at), -2)
