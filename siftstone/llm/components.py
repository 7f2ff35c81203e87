"""Connected components of a table of links, by rounds of joins (alternating large-star and small-star steps)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import BROADCAST_ROWS, counted_join, forget, scratch, written


def _star(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """Each node's neighbours (larger: those above it; else those below, and itself) linked to its least neighbour.

    A hub's rows aren't dealt by the hub: minima are broadcast where they are few or their node is hot.
    """
    near = edges.select(F.col("u").alias("n"), F.col("v").alias("w"))
    if larger:
        near = near.union(edges.select(F.col("v"), F.col("u")))
    least = near.groupBy("n").agg(F.min("w").alias("m"), F.count(F.lit(1)).alias("rows"))
    both = counted_join(near, least, ["n"], 2 * total if larger else total)
    if larger:
        pairs = both.where("w > n").select(F.col("w").alias("u"), F.least("m", "n").alias("v"))
    else:
        pairs = both.select(F.col("w").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select(F.col("n"), F.col("m")))
    return pairs.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link to another, given links (u, v) in any direction.

    component is the least node reachable. Repeated links, links of a node to itself and nulls do no harm. A node's
    neighbours never meet in one row or group: only minima and joins are taken, and rounds grow with the logarithm of a
    component's width. Each round is written to the shared folder, so lost executors cost that round at most.
    """
    with scratch() as made:
        edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        total = edges.count()
        while total:
            after = written(_star(_star(edges, True, total), False, total), "links")
            count = after.count()
            same = count == total and after.join(F.broadcast(edges) if total <= BROADCAST_ROWS else edges, ["u", "v"], "left_anti").isEmpty()
            forget(edges)
            edges, total = after, count
            if same:
                break
        made[:] = [t for t in made if t is not edges]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of n by pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return root
        root = new
