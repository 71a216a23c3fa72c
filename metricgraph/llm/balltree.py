"""A ball tree over sparse vectors of positive integers: exact inner-product search, best first."""

from __future__ import annotations

import heapq

import numpy as np

#: Vectors of a leaf. A group of equal vectors is halved like any other, so no leaf is larger.
LEAF = 48
#: Bounds are raised by this share of all that was added up, more than doubles can be wrong by.
SLACK = 1e-9


class BallTree:
    """Rows are given as (starts, terms, values), values integers; each row has at least one term. scale[t] is a positive
    double that stretches the axis of a term for bounds: queries are divided by it, so products stay the same."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray):
        self.terms_met, local = np.unique(terms, return_inverse=True)
        self.width, self.scale = len(self.terms_met), scale[self.terms_met]
        self.starts, self.terms, self.values = starts, local, values
        self.stretched = values * self.scale[local]
        self.squares = np.add.reduceat(self.stretched**2, starts[:-1]) if len(starts) > 1 else np.empty(0)
        #: Of each node: terms and values of its centroid, radius, first and last row, children (-1: leaf).
        self.centre: list[tuple[np.ndarray, np.ndarray]] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        self.order = np.arange(len(starts) - 1)
        self._build()
        # Rows of a leaf lie side by side.
        sizes = np.diff(starts)[self.order]
        at = self._entries(self.order)
        self.starts, self.terms, self.values = np.concatenate(([0], np.cumsum(sizes))), self.terms[at], values[at]

    def _entries(self, rows: np.ndarray) -> np.ndarray:
        """Places of all entries of some rows, row after row."""
        first, sizes = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)

    def _build(self) -> None:
        stack = [(0, len(self.order), -1, 0)]
        while stack:
            low, high, parent, side = stack.pop()
            node = len(self.radius)
            if parent >= 0:
                self.children[parent] = (node, self.children[parent][1]) if side == 0 else (self.children[parent][0], node)
            rows = self.order[low:high]
            at = self._entries(rows)
            terms, x = self.terms[at], self.stretched[at]
            cuts = np.concatenate(([0], np.cumsum(self.starts[rows + 1] - self.starts[rows])))[:-1]

            def products(point: np.ndarray, terms: np.ndarray = terms, x: np.ndarray = x, cuts: np.ndarray = cuts) -> np.ndarray:
                return np.add.reduceat(x * point[terms], cuts)

            centre = np.bincount(terms, x, self.width) / max(1, len(rows))
            length = float(centre @ centre)
            away = self.squares[rows] - 2 * products(centre) + length
            met = np.flatnonzero(centre)
            self.centre.append((met, centre[met]))
            # A distance is a difference of larger numbers: the slack is taken from those.
            self.radius.append(float(np.sqrt(max(0.0, away.max()) + SLACK * (self.squares[rows].max() + length))))
            self.span.append((low, high))
            self.children.append((-1, -1))
            if len(rows) <= LEAF:
                continue
            far = self._dense(rows[away.argmax()])
            other = self._dense(rows[(self.squares[rows] - 2 * products(far)).argmax()])
            middle = len(rows) // 2
            self.order[low:high] = rows[np.argpartition(products(far - other), middle)]
            stack += [(low, low + middle, node, 0), (low + middle, high, node, 1)]

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        at = slice(self.starts[row], self.starts[row + 1])
        out[self.terms[at]] = self.stretched[at]
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, theta: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, products, leaves looked at): at least all rows that are among the k greatest products and have theta or more.

        terms are distinct and ascending, weights non-negative integers; products are integers of 64 bits, made at leaves. A
        node's bound is query . centroid + |query| radius, rounded up, where only terms count that a row below the node has (all
        values are positive, so these are the terms of the centroid); nodes are taken by descending bound, until no bound
        reaches theta, which grows to the k-th product found.
        """
        place = np.searchsorted(self.terms_met, terms)
        held = place < self.width
        held[held] = self.terms_met[place[held]] == terms[held]
        if not held.any() or not len(self.order):
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        exact, near = np.zeros(self.width, np.int64), np.zeros(self.width)
        exact[place[held]] = weights[held]
        near[place[held]] = weights[held] / self.scale[place[held]]

        def bound(node: int) -> float:
            met, centre = self.centre[node]
            asked = near[met]
            return (float(asked @ centre) + float(np.sqrt(asked @ asked)) * self.radius[node]) * (1 + SLACK)

        heap, rows, found, looked = [(-bound(0), 0)], np.empty(0, np.int64), np.empty(0, np.int64), 0
        while heap and -heap[0][0] >= theta:
            _, node = heapq.heappop(heap)
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    if (b := bound(child)) >= theta:
                        heapq.heappush(heap, (-b, child))
                continue
            looked += 1
            low, high = self.span[node]
            first, last = self.starts[low], self.starts[high]
            products = np.add.reduceat(self.values[first:last] * exact[self.terms[first:last]], self.starts[low:high] - first)
            good = np.flatnonzero(products >= theta)
            if len(good):
                rows, found = np.concatenate((rows, self.order[low + good])), np.concatenate((found, products[good]))
                if len(found) >= k:
                    theta = max(theta, int(np.partition(found, len(found) - k)[len(found) - k]))
                    rows, found = rows[found >= theta], found[found >= theta]
        return rows, found, looked
