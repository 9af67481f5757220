"""Signature trees over sets of 64-bit tokens, and the dual traversal that joins two of them by Jaccard similarity.

A leaf entry has a bitmap of its tokens (hashed to a power of two of bits) and its size; a node has the OR of its children's
bitmaps, their range of sizes and their largest slack, which is size less set bits. Two sets below nodes A and B share at
most popcount(A & B) + slack tokens; a pair of nodes for which no sizes in range reach the similarity with that overlap is
dropped, as is every pair below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

FANOUT, FRONTIER_BYTES = 8, 8 << 20


@dataclass
class Level:
    bits: np.ndarray  # (nodes, words of 64 bits)
    least: np.ndarray
    most: np.ndarray
    slack: np.ndarray


def width(sizes: np.ndarray) -> int:
    """Bits for sets of these sizes: about four for a token of a typical set."""
    typical = float(np.median(sizes)) if len(sizes) else 1.0
    return int(2 ** np.clip(np.ceil(np.log2(max(typical, 1) * 4)), 8, 15))


def bitmaps(tokens: np.ndarray, offsets: np.ndarray, n_bits: int) -> np.ndarray:
    n = len(offsets) - 1
    flat = np.zeros((n, n_bits // 8), np.uint8)
    at = ((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - n_bits.bit_length() + 1)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    np.bitwise_or.at(flat.reshape(-1), row * (n_bits // 8) + (at >> 3), (1 << (at & 7)).astype(np.uint8))
    return flat.view(np.uint64)


def popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1, dtype=np.int64)


class Tree:
    """Sets in order of size, then of their least tokens, so that near-equal sets share nodes."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, n_bits: int):
        sizes = np.diff(offsets)
        first = tokens[np.minimum(offsets[:-1], len(tokens) - 1)] if len(tokens) else np.zeros(len(sizes), np.uint64)
        self.order = np.lexsort((first, sizes))
        bits = bitmaps(tokens, offsets, n_bits)[self.order]
        size = sizes[self.order]
        self.levels = [Level(bits, size, size, size - popcount(bits))]
        while len(self.levels[-1].least) > 1:
            below = self.levels[-1]
            cut = np.arange(0, len(below.least), FANOUT)
            self.levels.append(Level(np.bitwise_or.reduceat(below.bits, cut), np.minimum.reduceat(below.least, cut), np.maximum.reduceat(below.most, cut), np.maximum.reduceat(below.slack, cut)))


def _possible(a: Level, i: np.ndarray, b: Level, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some sizes in range, with the largest possible overlap, reach the similarity."""
    shared = popcount(a.bits[i] & b.bits[j]) + np.minimum(a.slack[i], b.slack[j])
    shared = np.minimum(shared, np.minimum(a.most[i], b.most[j]))
    union = np.maximum(a.least[i], shared) + np.maximum(b.least[j], shared) - shared
    return 100 * shared >= percent * union


def _close(a: Level, i: np.ndarray, b: Level, j: np.ndarray, percent: int) -> np.ndarray:
    """For two sets: a bit that only one has stands for a token that only it has."""
    x, y = a.bits[i], b.bits[j]
    shared = np.minimum(a.least[i] - popcount(x & ~y), b.least[j] - popcount(y & ~x))
    return 100 * shared >= percent * (a.least[i] + b.least[j] - shared)


def _children(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the parent in at, child) for all children of nodes at, the level below having n nodes."""
    child = at[:, None] * FANOUT + np.arange(FANOUT)
    ok = child < n
    return np.nonzero(ok)[0], child[ok]


def candidates(a: Tree, b: Tree, percent: int):
    """Yields arrays (i, j) of leaf places whose bitmaps allow the similarity; a is b joins a tree with itself, i < j."""
    same = a is b
    if not len(a.levels[0].least) or not len(b.levels[0].least):
        return
    most = max(64, FRONTIER_BYTES // a.levels[0].bits.shape[1] // 8)  # pairs whose bitmaps are compared at once
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > most:
            for k in range(0, len(i), most):
                stack.append((la, lb, i[k : k + most], j[k : k + most]))
            continue
        keep = _possible(a.levels[la], i, b.levels[lb], j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            if same:
                i, j = i[i < j], j[i < j]
            keep = _close(a.levels[0], i, b.levels[0], j, percent)
            if keep.any():
                yield i[keep], j[keep]
            continue
        if same:  # both sides descend together, and a pair of nodes is met once
            parent, ci = _children(i, len(a.levels[la - 1].least))
            other, cj = _children(j[parent], len(b.levels[lb - 1].least))
            ci = ci[other]
            once = ci <= cj
            stack.append((la - 1, lb - 1, ci[once], cj[once]))
        elif la >= lb:
            parent, ci = _children(i, len(a.levels[la - 1].least))
            stack.append((la - 1, lb, ci, j[parent]))
        else:
            parent, cj = _children(j, len(b.levels[lb - 1].least))
            stack.append((la, lb - 1, i[parent], cj))


class Forest:
    """Union-find over places, with labels that can be compared as an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def flat(self) -> np.ndarray:
        while True:
            jumped = self.up[self.up]
            if (jumped == self.up).all():
                return self.up
            self.up = jumped

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def every_link(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place in a, places in b) of similar sets; without b, of a with itself, each pair once. A place of a can come again."""
    both = sets_a if sets_b is None else sets_a + sets_b
    size = np.array([len(s) for s in both], np.int64)
    offsets = np.cumsum(np.append(0, size))
    tokens = np.concatenate(both) if both else np.empty(0, np.uint64)
    n_bits = width(size)
    a = Tree(tokens[: offsets[len(sets_a)]], offsets[: len(sets_a) + 1], n_bits)
    b, shift = (a, 0) if sets_b is None else (Tree(tokens[offsets[len(sets_a)] :], offsets[len(sets_a) :] - offsets[len(sets_a)], n_bits), len(sets_a))
    known, tokens = np.unique(tokens, return_inverse=True)
    mark = np.zeros(len(known), bool)
    for i, j in candidates(a, b, percent):
        i, j = a.order[i], b.order[j]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        head = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.empty(0, np.int64)
        for first, last in zip(head.tolist(), [*head[1:].tolist(), len(i)], strict=True):
            x, y = int(i[first]), j[first:last]
            other = size[y + shift]
            ends = np.cumsum(other)
            flat = np.arange(ends[-1]) + np.repeat(offsets[y + shift] - (ends - other), other)
            own = tokens[offsets[x] : offsets[x + 1]]
            mark[own] = True
            met = np.cumsum(np.append(0, mark[tokens[flat]]))
            mark[own] = False
            shared = met[ends] - met[ends - other]
            linked = y[100 * shared >= percent * (size[x] + other - shared)]
            if len(linked):
                yield x, linked


def links(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of similar sets; without b, of a with itself.

    every: all of them; else as many as connect what is connected, so pairs that are known to be are not compared."""
    own = sets_b is None
    both = sets_a if own else sets_a + sets_b
    forest = Forest(len(both))
    n_bits = width(np.array([len(s) for s in both]))

    def tree(sets):
        offsets = np.cumsum([0, *map(len, sets)])
        return Tree(np.concatenate(sets) if sets else np.empty(0, np.uint64), offsets, n_bits)

    a = tree(sets_a)
    b, shift = (a, 0) if own else (tree(sets_b), len(sets_a))
    out = []
    for i, j in candidates(a, b, percent):
        i, j = a.order[i], b.order[j]
        if not every:
            label = forest.flat()
            apart = label[i] != label[j + shift]
            i, j = i[apart], j[apart]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if (every or forest.find(x) != forest.find(y + shift)) and similar(both[x], both[y + shift], percent):
                forest.join(x, y + shift)
                out.append((x, y))
    return out
