"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), in DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_KEYS, beside, dropped, tabled


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, total: int, heavy_keys: int) -> DataFrame:
    """Each neighbour above a node is linked to the least of the node and its neighbours."""
    both = _both(edges)
    least = _least(both).withColumn("m", F.least("a", "m"))
    return beside(both, least, "a", 2 * total, heavy_keys).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int, heavy_keys: int) -> DataFrame:
    """Each neighbour below a node, and the node, are linked to the least of them."""
    least = _least(edges)
    others = beside(edges, least, "a", total, heavy_keys).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """edges (a long, b long) -> (node, root): the least node that each linked node reaches.

    Direction and repeats don't matter; self-links and links with a null are left out. No edges give no rows. Nodes
    without links don't appear. Every step is written as a table, and the one before it deleted; rounds grow with the logarithm of a
    component's width. The root of a giant component is the neighbour of all its nodes: what such heavy nodes lead to is broadcast,
    and their links aren't dealt by them.
    """
    clean = edges.filter("a <> b")
    now, path = tabled(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or mark["n"] == 0:
            break
        before = mark
        large, last = tabled(_large_star(now, mark["n"], heavy_keys))
        dropped(now.sparkSession, path)
        now, path = tabled(_small_star(large, mark["n"], heavy_keys))
        dropped(now.sparkSession, last)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between numbers -> at most one link a number, to the least number of its component among these links."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]
