"""Self-join of a binary trie: pairs of keys that differ in few bits.

A bucket of sorted keys is a binary trie whose nodes are runs of the array. Pairs of nodes are walked down
together from the pair (root, root); a step to unequal bits costs one error, and a pair over the budget is pruned
with all below it. As only components are asked for, a pair is pruned too when all keys of both nodes are in one
component already. Many buckets are walked at once, one level at a time, in chunks of node pairs.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 16
HUB_FROM, HUBS = 64, 8


class Forest:
    """Components of the places 0..n-1, as the least place of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def _near(x: np.ndarray, y: np.ndarray, budget: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= budget


def _pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of each pair of runs."""
    width = b1 - b0
    sizes = (a1 - a0) * width
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a0[of] + at // width[of], b0[of] + at % width[of]


def components(keys: np.ndarray, starts: np.ndarray, weight: np.ndarray, budget: int, bits: int = 64) -> np.ndarray:
    """Per key the least place of its component.

    keys: unsigned 64-bit, sorted within each bucket; starts: where buckets begin. weight: keys that many rows
    share are tried first as hubs of a large bucket, which only saves steps.
    """
    n = len(keys)
    forest = Forest(n)
    ends = np.append(starts[1:], n)
    for s, e in zip(starts[ends - starts >= HUB_FROM], ends[ends - starts >= HUB_FROM], strict=True):
        for hub in s + np.argsort(-weight[s:e], kind="stable")[:HUBS]:
            near = s + np.flatnonzero(_near(keys[s:e], keys[hub], budget))
            forest.link(near, np.full(len(near), hub))
    waiting = [(starts, ends, starts, ends, np.zeros(len(starts), np.int8), 0)]
    while waiting:
        a0, a1, b0, b1, errors, depth = waiting.pop()
        if len(a0) > CHUNK:
            half = len(a0) // 2
            waiting += [tuple(x[part] for x in (a0, a1, b0, b1, errors)) + (depth,) for part in (slice(half), slice(half, None))]
            continue
        # Nodes of one component: no label changes inside, and the same on both sides.
        changes = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])
        same = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (forest.label[a0] == forest.label[b0])
        go = np.flatnonzero(~same)
        a0, a1, b0, b1, errors = (x[go] for x in (a0, a1, b0, b1, errors))
        small = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if depth == bits:
            small[:] = True
        leaf, inner = np.flatnonzero(small), np.flatnonzero(~small)
        i, j = _pairs(a0[leaf], a1[leaf], b0[leaf], b1[leaf])
        near = np.flatnonzero((i < j) & _near(keys[i], keys[j], budget))
        forest.link(i[near], j[near])
        if not len(inner):
            continue
        a0, a1, b0, b1, errors = (x[inner] for x in (a0, a1, b0, b1, errors))
        am, bm = _split(keys, a0, a1, depth, bits), _split(keys, b0, b1, depth, bits)
        own = (a0 == b0) & (a1 == b1)
        steps = [(a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, errors + 1)]
        steps.append(tuple(x[~own] for x in (am, a1, b0, bm, errors + 1)))
        a0, a1, b0, b1, errors = (np.concatenate(x) for x in zip(*steps, strict=True))
        keep = np.flatnonzero((a0 < a1) & (b0 < b1) & (errors <= budget))
        if len(keep):
            waiting.append(tuple(x[keep] for x in (a0, a1, b0, b1, errors)) + (depth + 1,))
    return forest.label


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Where the keys of each run turn from 0 to 1 at this depth."""
    lo, hi = lo.copy(), hi.copy()
    bit = np.uint64(1 << (bits - 1 - depth))
    while len(open_ := np.flatnonzero(lo < hi)):
        middle = (lo[open_] + hi[open_]) // 2
        one = (keys[middle] & bit) != 0
        hi[open_] = np.where(one, middle, hi[open_])
        lo[open_] = np.where(one, lo[open_], middle + 1)
    return lo
