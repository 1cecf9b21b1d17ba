"""A wavelet matrix: token ids as succinct bit-planes in one compressed file.

Plane b holds the b-th most significant bit of every id, in the order that a stable partition by the planes above
gives. With ranks of ones at every ``BLOCK`` bits, access, counting and finding an id take one step per plane and
read no ids in between.

File: magic, width, count of ids, count of documents (little-endian), then length-prefixed zstd frames: document
keys (64-bit, with a byte for null), document lengths, and each plane followed by the number of its zeros.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK = 512


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max(initial=0)).bit_length())
        current = ids.astype(np.uint16 if width <= 16 else np.uint32)
        below = np.empty_like(current)
        planes, zeros = [], []
        for bit in range(width - 1, -1, -1):
            ones = (current & (1 << bit)) != 0
            planes.append(np.packbits(ones))
            high, low = np.flatnonzero(ones), np.flatnonzero(~ones)
            zeros.append(len(low))
            np.take(current, low, out=below[: len(low)], mode="clip")
            np.take(current, high, out=below[len(low) :], mode="clip")
            current, below = below, current
        return cls(planes, zeros, len(ids))

    def all(self) -> np.ndarray:
        """Every id, from the last plane up: each step undoes one stable partition."""
        width = len(self.planes)
        kind = np.uint16 if width <= 16 else np.uint32
        current = np.zeros(self.n, kind)
        for depth in range(width - 1, -1, -1):
            ones = np.unpackbits(self.planes[depth], count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = current[: self.zeros[depth]]
            above[np.flatnonzero(ones)] = current[self.zeros[depth] :] | kind(1 << (width - 1 - depth))
            current = above
        return current.astype(np.uint32)

    @cached_property
    def _ranks(self) -> list[np.ndarray]:
        """Ones before every block of each plane."""
        out = []
        for plane in self.planes:
            bits = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8)
            out.append(np.concatenate([[0], np.cumsum(bits.sum(axis=1, dtype=np.int64))]))
        return out

    def _ones(self, depth: int, i: int) -> int:
        block = i // BLOCK
        first = block * (BLOCK // 8)
        tail = np.unpackbits(self.planes[depth][first : first + BLOCK // 8])[: i - block * BLOCK]
        return int(self._ranks[depth][block]) + int(tail.sum())

    def access(self, i: int) -> int:
        value = 0
        for depth in range(len(self.planes)):
            before = self._ones(depth, i)
            one = self._ones(depth, i + 1) - before
            i = self.zeros[depth] + before if one else i - before
            value = value << 1 | one
        return value

    def count(self, value: int, start: int, end: int) -> int:
        """How often the id occurs from start up to end."""
        if value >> len(self.planes):
            return 0
        for depth in range(len(self.planes)):
            a, b = self._ones(depth, start), self._ones(depth, end)
            one = value >> (len(self.planes) - 1 - depth) & 1
            start, end = (self.zeros[depth] + a, self.zeros[depth] + b) if one else (start - a, end - b)
        return end - start

    def _select(self, depth: int, one: int, k: int) -> int:
        """The place of the k-th one or zero of a plane, from 0."""
        ranks = self._ranks[depth]
        before = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        first = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[depth][first : first + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def find(self, value: int, k: int) -> int:
        """The place of the id's k-th occurrence, from 0; -1 if there are fewer."""
        if k < 0 or k >= self.count(value, 0, self.n):
            return -1
        start = 0
        ones = [value >> (len(self.planes) - 1 - depth) & 1 for depth in range(len(self.planes))]
        for depth, one in enumerate(ones):
            a = self._ones(depth, start)
            start = self.zeros[depth] + a if one else start - a
        place = start + k
        for depth in range(len(self.planes) - 1, -1, -1):
            one = ones[depth]
            place = self._select(depth, one, place - self.zeros[depth] if one else place)
        return place


def write(keys: list[int | None], documents: list[np.ndarray]) -> bytes:
    """The file of a shard's documents."""
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    matrix = WaveletMatrix.build(ids)
    frames = [
        np.array([0 if k is None else k for k in keys], "<i8").tobytes() + bytes(k is None for k in keys),
        np.array([len(d) for d in documents], "<i8").tobytes(),
        *(z.to_bytes(8, "little") + p.tobytes() for p, z in zip(matrix.planes, matrix.zeros, strict=True)),
    ]
    pack = zstandard.ZstdCompressor(level=1)
    packed = [pack.compress(f) for f in frames]
    head = MAGIC + struct.pack("<Bqq", len(matrix.planes), len(ids), len(keys))
    return head + b"".join(struct.pack("<q", len(p)) + p for p in packed)


def read(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Keys and lengths of a file's documents, and their ids as a matrix."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet file")
    width, n, docs = struct.unpack_from("<Bqq", data, 4)
    at, frames = 4 + struct.calcsize("<Bqq"), []
    unpack = zstandard.ZstdDecompressor()
    for _ in range(width + 2):
        (size,) = struct.unpack_from("<q", data, at)
        frames.append(unpack.decompress(data[at + 8 : at + 8 + size]))
        at += 8 + size
    null = frames[0][8 * docs :]
    keys = [None if null[i] else int(k) for i, k in enumerate(np.frombuffer(frames[0], "<i8", docs))]
    planes = [np.frombuffer(f, np.uint8, offset=8) for f in frames[2:]]
    zeros = [int.from_bytes(f[:8], "little") for f in frames[2:]]
    return keys, np.frombuffer(frames[1], "<i8"), WaveletMatrix(planes, zeros, n)
