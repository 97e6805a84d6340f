"""Points of a part of the plane in boxes: how many lie in each below a weight, and which is the lightest.

A tree halves the points by y, weight and x in turn; all boxes go down it together. A part of the tree that a box holds
whole answers by its count and its lightest point, so a box costs far fewer steps than there are points."""

from __future__ import annotations

import numpy as np

#: Points of a leaf, and boxes that go down the tree at a time.
LEAF = 8
CHUNK = 512


class Tree:
    """points: rows of (x, y, weight), whole numbers of 64 bits."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.points = points[np.lexsort((points[:, 1], points[:, 0], points[:, 2]))]  # the lightest first, then the least x and y
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        size = LEAF << self.depth
        # n stands for no point: it comes last by all columns
        order = np.arange(size).clip(max=n)
        column = np.concatenate((self.points, np.full((1, 3), np.iinfo(np.int64).max)))
        for level in range(self.depth):
            by = column[order, (1, 2, 0)[level % 3]].reshape(1 << level, -1)
            # no point behind all points, those of the greatest number too
            turn = np.lexsort((order.reshape(by.shape) == n, by), axis=1)
            order = np.take_along_axis(order.reshape(by.shape), turn, axis=1).ravel()
        self.leaves = order.reshape(-1, LEAF)
        self.column = column
        real = self.leaves < n
        low = np.where(real[..., None], column[self.leaves], np.iinfo(np.int64).max).min(1)
        high = np.where(real[..., None], column[self.leaves], np.iinfo(np.int64).min).max(1)
        self.levels = [(low, high, real.sum(1), self.leaves.min(1))]
        while len(self.levels[0][0]) > 1:
            low, high, count, light = self.levels[0]
            self.levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), count[::2] + count[1::2], np.minimum(light[::2], light[1::2])))

    def answer(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For boxes of rows of the least and the greatest (x, y, weight) allowed: how many points, and the number of the
        lightest in self.points, len(self.points) where there is none."""
        count, light = np.zeros(len(least), np.int64), np.full(len(least), len(self.points), np.int64)
        for a in range(0, len(least), CHUNK):
            lo, hi = least[a : a + CHUNK], most[a : a + CHUNK]
            c, l = count[a : a + CHUNK], light[a : a + CHUNK]
            box, node = np.arange(len(lo)), np.zeros(len(lo), np.int64)
            for level, (low, high, n, first) in enumerate(self.levels):
                b, t, x, y = lo[box], hi[box], low[node], high[node]
                meets = ((x <= t) & (y >= b)).all(1) & (n[node] > 0)
                whole = meets & ((x >= b) & (y <= t)).all(1)
                np.add.at(c, box[whole], n[node[whole]])
                np.minimum.at(l, box[whole], first[node[whole]])
                rest = meets & ~whole
                box, node = box[rest], node[rest]
                if level < self.depth:
                    box, node = np.repeat(box, 2), np.repeat(2 * node, 2)
                    node[1::2] += 1
            if len(box):
                place = self.leaves[node]
                at = self.column[place]
                inside = ((at >= lo[box][:, None]) & (at <= hi[box][:, None])).all(2) & (place < len(self.points))
                np.add.at(c, box, inside.sum(1))
                np.minimum.at(l, box, np.where(inside, place, len(self.points)).min(1))
        return count, light
