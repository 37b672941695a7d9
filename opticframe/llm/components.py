"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach

#: Edges up to which one task joins them all in memory, in place of the steps.
FEW_EDGES = 1 << 18


def connected_components(edges: DataFrame, scratch: Scratch, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) of all nodes of the edges (a long, b long); component: the smallest node that is reachable.

    Every step hooks each node to the least neighbour it sees, so that components become stars around
    their least node after a number of steps that grows with the logarithm of their size.  A step's edges
    are written to the shared folder; a node with very many edges is met by a broadcast (see attach).  Up to
    ``few`` distinct edges are joined by one task instead, with the same result.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def hooked(pairs: DataFrame, total: int) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("m", "a"))
        return attach(pairs, least, "a", "_n", total)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.save(oriented(edges))
    was = state(now)
    total = was[0]
    if total <= few:
        return now.select("a", "b", F.lit(0).alias("all")).groupBy("all").applyInArrow(_stars, "node long, component long")
    while total:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = scratch.save(oriented(hooked(both, 2 * total).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = hooked(large, large.count())
        after = scratch.save(oriented(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))))
        scratch.drop(now)
        scratch.drop(large)
        now, before, was = after, was, state(after)
        total = was[0]
        if was == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(edges: pa.Table) -> pa.Table:
    """(node, component) of a few edges."""
    nodes, at = np.unique(np.concatenate([edges.column("a").to_numpy(), edges.column("b").to_numpy()]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.join(at[: edges.num_rows], at[edges.num_rows :])
    return pa.table({"node": nodes, "component": nodes[forest.label]})


class Forest:
    """Union-find over 0..n-1 that takes arrays of pairs; every label is a root."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
