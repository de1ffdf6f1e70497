"""A trie over interval edges, in arrays; no Spark.

Nodes are numbered in the order of their reversed paths, so nodes whose paths end alike are neighbours.  An edge leads
from each node of an interval to the node at the same place of another one: a plain trie's intervals hold one node, a
merged one's as many as have equal paths ahead of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Trie:
    """Navigation: root, find_edge, follow_edge, has_leaf, failure_link, num_leaves, strings_length; and search."""

    def __init__(self, edges: np.ndarray, syms: list[str], fail: np.ndarray, leaves: dict[int, list[int]], depth: np.ndarray):
        """edges: rows (lo, size, to); fail: of each node, -1 for the root; leaves: records that end at a node."""
        order = np.argsort(edges[:, 0], kind="stable") if len(edges) else np.zeros(0, np.int64)
        self._lo, self._size, self._to = (edges[order, k] for k in range(3)) if len(edges) else (np.zeros(0, np.int64),) * 3
        self._syms = [syms[k] for k in order.tolist()]
        self.fail, self.leaves, self.depth = fail, leaves, depth
        # The first edge of each node: intervals either are equal or share no node.
        self._first = np.full(len(fail), -1, np.int64)
        for e in range(len(self._lo) - 1, -1, -1):
            self._first[self._lo[e] : self._lo[e] + self._size[e]] = e
        self._ends: dict[int, list[tuple[int, int]]] = {}

    @property
    def root(self) -> int:
        return 0

    def edge_range(self, node: int) -> tuple[int, int]:
        """Numbers of a node's edges, the last excluded."""
        first = int(self._first[node])
        if first < 0:
            return (0, 0)
        end = first
        while end < len(self._lo) and self._lo[end] == self._lo[first]:
            end += 1
        return first, end

    def edge(self, e: int) -> tuple[str, int, int]:
        """(symbol, first node of its interval, first node that it leads to)."""
        return self._syms[e], int(self._lo[e]), int(self._to[e])

    def find_edge(self, node: int, sym: str) -> int | None:
        first, end = self.edge_range(node)
        return next((e for e in range(first, end) if self._syms[e] == sym), None)

    def follow_edge(self, e: int, node: int) -> int:
        return int(self._to[e] + node - self._lo[e])

    def has_leaf(self, node: int) -> bool:
        return node in self.leaves

    def failure_link(self, node: int) -> int:
        return int(self.fail[node])

    def num_leaves(self) -> int:
        return len(self.leaves)

    def strings_length(self) -> int:
        """Symbols of all distinct strings."""
        return int(sum(self.depth[n] for n in self.leaves))

    def found_at(self, node: int) -> list[tuple[int, int]]:
        """(record, length) of all strings that end at a node: its own, and those of its failure links."""
        if (out := self._ends.get(node)) is None:
            out, at = [], node
            while at > 0:
                out += [(r, int(self.depth[at])) for r in self.leaves.get(at, ())]
                at = int(self.fail[at])
            self._ends[node] = out
        return out

    def search(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, record) of every occurrence in the text."""
        at, steps = 0, {}
        for end, sym in enumerate(text, 1):
            key = (at, sym)
            if (to := steps.get(key)) is None:
                node = at
                while (e := self.find_edge(node, sym)) is None and node:
                    node = int(self.fail[node])
                to = steps[key] = 0 if e is None else self.follow_edge(e, node)
                if len(steps) > 200_000:
                    steps.clear()
            at = to
            for record, _ in self.found_at(at):
                yield end, record
