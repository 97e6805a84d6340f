"""Connected components: in memory for one split, and over a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def local_components(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """label with the components of u and v joined; a label is the least index of its component."""
    label = label.copy()
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label = next_


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) but the roots themselves: alternating large and small stars.

    Each round sends the neighbours of a node to the least of them; rounds are cut by checkpoints and their number
    grows with the logarithm of the longest path."""
    star = lambda t: t.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = cut(star(edges))
    known = _state(current)
    while True:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        large = both.select("a", "b", least.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = star(large).select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        nxt = cut(star(small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")))))
        state = _state(nxt)
        current = nxt
        if state == known:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = state


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())
