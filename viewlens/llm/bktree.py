"""BK-trees over 64-bit fingerprints: every child hangs on the edge that bears its Hamming
distance to the parent. Many trees are built and searched together, level by level, in numpy."""

from __future__ import annotations

import numpy as np

#: Edges have numbers 0 to 64.
_EDGES = 65
#: Pairs of query and node looked at in one step.
_FRONTIER = 1 << 20


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One tree for each number in ``tree`` (ascending); nodes are indexes of ``values``."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values, self.tree = values, tree
        self.roots = np.flatnonzero(np.diff(tree, prepend=-1))
        counts = np.diff(np.append(self.roots, len(values)))
        at = np.repeat(self.roots, counts)
        here = np.setdiff1d(np.arange(len(values)), self.roots, assume_unique=True)
        at = at[here]
        keys, children = [], []
        while len(here):
            key = at * _EDGES + distance(values[here], values[at])
            # the first to take an edge becomes the child there; the others go down to it
            edges, first, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edges)
            children.append(here[first])
            down = here[first][which]
            rest = down != here
            here, at = here[rest], down[rest]
        key = np.concatenate([*keys, np.empty(0, np.int64)])
        order = np.argsort(key)
        self._key, self._child = key[order], np.concatenate([*children, np.empty(0, np.int64)])[order]

    def near(self, queries: np.ndarray, tree: np.ndarray, radius: int):
        """Yields (query's index, node) of all pairs within ``radius``, searching for each query
        the tree at that place of ``roots``. Only edges within the radius of the query's
        distance are followed."""
        step = 256
        for begin in range(0, len(queries), step):
            query = np.arange(begin, min(begin + step, len(queries)))
            stack = [(query, self.roots[tree[query]])]
            while stack:
                query, node = stack.pop()
                if len(query) > _FRONTIER:
                    half = len(query) // 2
                    stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                apart = distance(queries[query], self.values[node])
                found = apart <= radius
                if found.any():
                    yield query[found], node[found]
                low = np.searchsorted(self._key, node * _EDGES + np.maximum(apart - radius, 0), side="left")
                high = np.searchsorted(
                    self._key, node * _EDGES + np.minimum(apart + radius, _EDGES - 1), side="right"
                )
                many = high - low
                if many.any():
                    skip = np.repeat(low - (np.cumsum(many) - many), many)
                    edge = skip + np.arange(len(skip))
                    stack.append((np.repeat(query, many), self._child[edge]))


class Groups:
    """Union of indexes; each group's root is its smallest index."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        a, b = root[a], root[b]
        while len(a):
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = root[root]
                if np.array_equal(above, root):
                    break
                root[:] = above
            a, b = root[a], root[b]
