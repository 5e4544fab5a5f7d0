"""Walks over a graph of short names that each task has at hand: where names lead into each other densely, what is reached is
very much larger than the graph, and only what a query returns of it should ever be stored."""

from __future__ import annotations

import numpy as np

#: A graph of more edges isn't sent to the tasks; it is walked hop by hop.
AT_HAND = 1_000_000
#: Starts walked together, one bit of a word each, and the distances that are kept for them at once.
TOGETHER, DISTANCES = 64, 1 << 24
#: Starts that a task walks from, and bytes of names that its rows may hold: half of what a Parquet dictionary takes.
A_TASK, NAMES = 8 * TOGETHER, 1 << 19
#: The distance of what isn't reached.
FAR = np.iinfo(np.int32).max


class Graph:
    """Nodes 0 to ``n`` - 1 with edges by their ends; all distances from many starts at once."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray) -> None:
        order = np.argsort(dst, kind="stable")
        self.n, self.src, ends = n, np.asarray(src, np.int32)[order], np.asarray(dst, np.int32)[order]
        self.first = np.flatnonzero(np.diff(ends, prepend=-1))
        self.ends = ends[self.first]

    @property
    def together(self) -> int:
        return int(max(1, min(TOGETHER, DISTANCES // max(1, self.n))))

    def distances(self, starts: list[np.ndarray]) -> np.ndarray:
        """(starts, nodes): the least number of hops from any node of each start, FAR where there is none; ``together`` starts at most."""
        out = np.full((self.n, len(starts)), FAR, np.int32)
        seen = np.zeros(self.n, np.uint64)
        for bit, nodes in enumerate(starts):
            seen[nodes] |= np.uint64(1 << bit)
            out[nodes, bit] = 0
        new, hop = seen.copy(), 0
        while len(self.first) and new.any():
            hop += 1
            reached = np.bitwise_or.reduceat(new[self.src], self.first)
            new = np.zeros(self.n, np.uint64)
            new[self.ends] = reached & ~seen[self.ends]
            rows = np.flatnonzero(new)
            bits = np.unpackbits(new[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=len(starts)).view(bool)
            part = out[rows]
            part[bits] = hop
            out[rows] = part
            seen |= new
        return out.T


def coded(*columns: list) -> tuple[list, list[np.ndarray]]:
    """The distinct values of all columns in order, and each column as their places."""
    values = sorted(set().union(*columns))
    place = {v: i for i, v in enumerate(values)}
    return values, [np.fromiter((place[v] for v in c), np.int64, len(c)) for c in columns]


def parts(values: list[str], most: int | None = None) -> list[tuple[int, int]]:
    """(first, last) of ranges that ``values`` are cut into: ``NAMES`` bytes each and ``most`` values, but one value at least."""
    out, first, held = [], 0, 0
    for i, v in enumerate(values):
        more = len(v.encode()) + 4
        if i > first and (held + more > NAMES or i - first == most):
            out.append((first, i))
            first, held = i, 0
        held += more
    return [*out, (first, len(values))] if values else []
