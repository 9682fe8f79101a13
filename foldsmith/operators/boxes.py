"""Trees of boxes for the exact nearest rows of narrow vectors.

Few coordinates are searched by cuts along them: a box whose nearest point lies beyond a query's
bound is closed with everything in it, so a query looks at a few dozen rows however many there
are. The same search runs over the boxes that training rows are dealt into (:class:`Tree.cut`,
from a sample) and over the rows of one box (:class:`Tree.build`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Rows of a leaf.
LEAF = 32

# Relative slack that keeps pruning safe against rounding.
SLACK = 1e-9

# Queries that are searched at a time, and pairs of a query and a leaf's rows that are measured at
# a time.
QUERIES, PAIRS = 4_000, 1_000_000

# The nearest so many leaves of a query are measured first, as they may close the others.
WAVES = (3, 12)


@dataclass(frozen=True)
class Tree:
    """Nodes with the least and largest coordinates below them. Leaves have no children and
    a number; inner nodes of :meth:`cut` send coordinates up to ``value`` to the left."""

    low: np.ndarray
    high: np.ndarray
    left: np.ndarray  # -1 at leaves
    right: np.ndarray
    number: np.ndarray
    axis: np.ndarray
    value: np.ndarray
    rows: np.ndarray  # leaves x places: the rows of a leaf, -1 where there are fewer

    @classmethod
    def cut(cls, sample: np.ndarray, leaves: int) -> Tree:
        """Cuts through the medians of the sample along its widest coordinate, so that each of
        about ``leaves`` leaves has as many rows of it. Leaves are numbered from 0; their boxes
        are set by :meth:`bounded`."""
        left, right, number, axis, value = [], [], [], [], []
        todo = [(np.arange(len(sample)), leaves, None)]
        count = 0
        while todo:
            rows, wanted, parent = todo.pop()
            node = len(left)
            for column, default in ((left, -1), (right, -1), (number, -1), (axis, -1), (value, 0.0)):
                column.append(default)
            if parent is not None:
                (left if parent[1] else right)[parent[0]] = node
            x = sample[rows]
            spread = x.max(axis=0) - x.min(axis=0) if len(rows) else np.zeros(sample.shape[1])
            if wanted < 2 or not spread.max(initial=0) > 0:
                number[node] = count
                count += 1
                continue
            axis[node] = int(spread.argmax())
            along = x[:, axis[node]]
            ordered = np.sort(along)
            at = ordered[len(ordered) // 2 - 1]
            if at == ordered[-1]:
                at = ordered[ordered < at][-1]
            value[node] = at
            below = along <= at
            share = min(max(1, round(wanted * np.count_nonzero(below) / len(rows))), wanted - 1)
            todo.append((rows[~below], wanted - share, (node, False)))
            todo.append((rows[below], share, (node, True)))
        width = sample.shape[1]
        return cls(
            np.full((len(left), width), np.inf), np.full((len(left), width), -np.inf),
            *(np.array(c) for c in (left, right, number, axis, value)), np.zeros((0, 0), int),
        )

    def bounded(self, low: np.ndarray, high: np.ndarray) -> Tree:
        """The tree with the boxes of its leaves, by number, and of the nodes above them."""
        lows, highs = self.low.copy(), self.high.copy()
        leaf = self.left < 0
        lows[leaf], highs[leaf] = low[self.number[leaf]], high[self.number[leaf]]
        for node in reversed(range(len(self.left))):  # children come after their parent
            if self.left[node] >= 0:
                ends = [self.left[node], self.right[node]]
                lows[node], highs[node] = lows[ends].min(axis=0), highs[ends].max(axis=0)
        return Tree(lows, highs, self.left, self.right, self.number, self.axis, self.value, self.rows)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Number of the leaf that the cuts lead each row to."""
        node = np.zeros(len(x), int)
        at = np.arange(len(x)) if self.left[0] >= 0 else np.zeros(0, int)
        while len(at):
            here = node[at]
            below = x[at, self.axis[here]] <= self.value[here]
            node[at] = np.where(below, self.left[here], self.right[here])
            at = at[self.left[node[at]] >= 0]
        return self.number[node]

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        """A balanced tree over rows, halved along the widest coordinate down to the leaves."""
        n, width = x.shape
        depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
        order = np.arange(n)
        starts = np.array([0])
        for _ in range(depth):
            placed = x[order]
            spread = np.maximum.reduceat(placed, starts) - np.minimum.reduceat(placed, starts)
            sizes = np.diff(np.append(starts, n))
            part = np.repeat(np.arange(len(starts)), sizes)
            along = placed[np.arange(n), spread.argmax(axis=1)[part]]
            order = order[np.lexsort((along, part))]
            starts = np.stack([starts, starts + (sizes + 1) // 2], axis=1).ravel()
        sizes = np.diff(np.append(starts, n))
        places = np.arange(sizes.max(initial=0))
        rows = np.where(places < sizes[:, None], order[np.minimum(starts[:, None] + places, n - 1)], -1)
        placed = x[order]
        lows, highs = [np.minimum.reduceat(placed, starts)], [np.maximum.reduceat(placed, starts)]
        while len(lows[0]) > 1:
            lows.insert(0, np.minimum(lows[0][::2], lows[0][1::2]))
            highs.insert(0, np.maximum(highs[0][::2], highs[0][1::2]))
        inner = len(starts) - 1
        nodes = np.arange(inner + len(starts))
        left = np.where(nodes < inner, 2 * nodes + 1, -1)
        return cls(
            np.concatenate(lows), np.concatenate(highs), left, np.where(left < 0, -1, left + 1),
            nodes - inner, np.full(len(nodes), -1), np.zeros(len(nodes)), rows,
        )

    def distance(self, x: np.ndarray, node: np.ndarray, p: float) -> np.ndarray:
        """Least distance of each row of ``x`` to the box of its node."""
        total = np.zeros(len(x))
        for i in range(x.shape[1]):
            gap = np.maximum(np.maximum(self.low[node, i] - x[:, i], x[:, i] - self.high[node, i]), 0.0)
            total = np.maximum(total, gap) if p == math.inf else total + (gap if p == 1 else gap**p)
        return total if p in (1, math.inf) else np.sqrt(total) if p == 2 else total ** (1.0 / p)

    def reached(self, x: np.ndarray, limit: np.ndarray, p: float):
        """(row of x, number of leaf, least distance to its box) of all leaves within the row's limit."""
        at, node, low = np.arange(len(x)), np.zeros(len(x), int), np.zeros(len(x))
        found = [(at[:0], node[:0], low[:0])]
        while len(at):
            end = self.left[node] < 0
            found.append((at[end], self.number[node[end]], low[end]))
            at, node = at[~end], node[~end]
            at, node = np.concatenate([at, at]), np.concatenate([self.left[node], self.right[node]])
            low = self.distance(x[at], node, p)
            near = low <= limit[at]
            at, node, low = at[near], node[near], low[near]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def nearest(self, x: np.ndarray, p: float) -> np.ndarray:
        """Number of the leaf that the nearer child leads to, from the top; of equally near ones,
        such as boxes that share a border full of rows, the one with the nearer middle."""
        node = np.zeros(len(x), int)
        middle = (self.low + self.high) / 2
        while self.left[node[0]] >= 0:  # all leaves of a balanced tree are equally deep
            left, right = self.left[node], self.right[node]
            gap = self.distance(x, left, p) - self.distance(x, right, p)
            off = np.abs(x - middle[left]).max(axis=1) - np.abs(x - middle[right]).max(axis=1)
            node = np.where((gap < 0) | ((gap == 0) & (off <= 0)), left, right)
        return self.number[node]

    def search(self, x: np.ndarray, limit: np.ndarray, train: np.ndarray, k: int, p: float):
        """(row of x, training row, distance) of the k nearest within the limit of each row of
        ``x``, ties to the lower training row. The tree is built over ``train``."""
        found = []
        for start in range(0, len(x), QUERIES):
            some = slice(start, start + QUERIES)
            found.append(self._search(x[some], limit[some], train, k, p, start))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _search(self, x, limit, train, k: int, p: float, start: int):
        if self.rows.shape[1] >= k:
            _, d = self._measure(x, np.arange(len(x)), self.nearest(x, p), train, p)
            own = np.partition(d, k - 1, axis=1)[:, k - 1]
            limit = np.minimum(limit, own * (1 + SLACK) + SLACK)
        at, leaf, low = self.reached(x, limit, p)
        order = np.lexsort((low, at))
        at, leaf, low = at[order], leaf[order], low[order]
        turn = np.arange(len(at)) - np.searchsorted(at, at)
        best = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for first, end in zip((0, *WAVES), (*WAVES, len(at)), strict=True):
            some = (turn >= first) & (turn < end) & (low <= limit[at])
            best, limit = self._nearer(x, at[some], leaf[some], train, limit, best, k, p)
        q, s, d = best
        return q + start, s, d

    def _nearer(self, x, at, leaf, train, limit, best, k: int, p: float):
        """The best k so far and those of more leaves, and the limits that follow from them."""
        step = max(1, PAIRS // max(1, self.rows.shape[1]))
        for begin in range(0, len(at), step):
            part = slice(begin, begin + step)
            rows, d = self._measure(x, at[part], leaf[part], train, p)
            i, j = np.nonzero((d <= limit[at[part]][:, None]) & (rows >= 0))
            q, s, d = (np.concatenate(c) for c in zip(best, (at[part][i], rows[i, j], d[i, j]), strict=True))
            order = np.lexsort((s, d, q))
            q, s, d = q[order], s[order], d[order]
            turn = np.arange(len(q)) - np.searchsorted(q, q)
            kept = turn < k
            best = q[kept], s[kept], d[kept]
            last = turn == k - 1
            limit = limit.copy()
            limit[q[last]] = np.minimum(limit[q[last]], d[last] * (1 + SLACK) + SLACK)
        return best, limit

    def _measure(self, x, at, leaf, train, p: float):
        """Rows of each leaf and their distances, coordinate by coordinate as everywhere."""
        rows = self.rows[leaf]
        total = np.zeros(rows.shape)
        for i in range(x.shape[1]):
            gap = np.abs(x[at, i][:, None] - train[:, i][rows])
            if p == math.inf:
                total = np.maximum(total, gap)
                continue
            if p == 2:
                gap *= gap
            elif p != 1:
                gap = np.power(gap, p)
            total += gap
        if p == 2:
            np.sqrt(total, out=total)
        elif p not in (1, math.inf):
            total = total ** (1.0 / p)
        total[rows < 0] = np.inf
        return rows, total
