"""Hierarchical index over 64-bit codes in Gray order, for all pairs within a few differing bits.

Codes are sorted by the rank their bits have in the reflected Gray code, so that neighbours share most bits. Every group
of neighbours keeps the bits that all its members share (a mask and a pattern); its parent keeps the shared part of those,
and a node only compares the bits that its parent did not. Differences add up on the way down, and a node whose sum
is beyond the radius drops its whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Members of a node.
FAN = 8
# Codes looked up at once.
BATCH = 512


def gray_rank(codes: np.ndarray) -> np.ndarray:
    out = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def gray_code(ranks: np.ndarray) -> np.ndarray:
    return ranks ^ (ranks >> np.uint64(1))


def rotate(codes: np.ndarray, bits: int) -> np.ndarray:
    """Bits moved to the left, around the end."""
    return codes if bits % 64 == 0 else (codes << np.uint64(bits % 64)) | (codes >> np.uint64(64 - bits % 64))


class GrayIndex:
    """Index of distinct codes; ``order`` gives their places in the input."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask, pattern) of the nodes, leaves' parents first
        n, size = len(codes), FAN
        while n:
            starts = np.arange(0, n, size)
            first = self.codes[starts]
            differ = np.bitwise_or.reduceat(self.codes ^ np.repeat(first, np.diff(np.r_[starts, n])), starts)
            self.levels.append((~differ, first & ~differ))
            if len(starts) <= FAN:
                break
            size *= FAN

    def within(self, queries: np.ndarray, radius: int, equal: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, indexed code) by their places in the inputs, at most ``radius`` bits apart.

        ``equal`` is a mask of bits that must not differ at all.
        """
        if not len(self.codes):
            return
        same = np.uint64(equal)
        for at in range(0, len(queries), BATCH):
            own = queries[at : at + BATCH]
            top = len(self.levels[-1][0])
            q, node = np.repeat(np.arange(len(own)), top), np.tile(np.arange(top), len(own))
            seen, sums = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint8)
            for depth in range(len(self.levels) - 1, -2, -1):
                if depth >= 0:
                    mask, pattern = self.levels[depth][0][node], self.levels[depth][1][node]
                else:
                    mask, pattern = np.full(len(node), ~np.uint64(0)), self.codes[node]
                differ = (own[q] ^ pattern) & mask & ~seen
                sums = sums + np.bitwise_count(differ)
                good = (sums <= radius) & (differ & same == 0)
                q, node, sums, seen = q[good], node[good], sums[good], mask[good]
                if depth >= 0:  # down to the members
                    below = len(self.levels[depth - 1][0]) if depth else len(self.codes)
                    member = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    there = member < below
                    q, sums, seen, node = (np.repeat(x, FAN)[there] for x in (q, sums, seen, node))
                    node = member[there]
            yield at + q, self.order[node]


def roots_of(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if np.array_equal(up, at):
            return at
        at = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of the given pairs; a set's root is its least member."""
    while len(a):
        a, b = roots_of(parent, a), roots_of(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(codes: np.ndarray, home: np.ndarray, radius: int, equal: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(code, root) of the sets that links between any code and a code at ``home`` make; roots are left out."""
    codes, first = np.unique(codes, return_index=True)
    home = home[first]
    at_home = np.flatnonzero(home)
    parent = np.arange(len(codes))
    for q, c in GrayIndex(codes[at_home]).within(codes, radius, equal):
        unite(parent, q, at_home[c])
    roots = roots_of(parent, np.arange(len(codes)))
    moved = np.flatnonzero(roots != np.arange(len(codes)))
    return codes[moved], codes[roots[moved]]
