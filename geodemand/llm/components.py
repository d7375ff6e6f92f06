"""Connected components: unions inside a task, star contraction across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Forest:
    """Union-find over 0..n-1 that takes arrays of links; a root is its tree's smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = self.parent[up]

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(root, member) of every member that is no root."""
        member = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return self.find(member), member


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node of the component.

    Alternates large-star and small-star steps until the links are stars. Each
    step is a partial minimum per node and an equality join, so a hub's links are
    pre-aggregated and its join split by adaptive execution; the lineage is cut
    by checkpoint() after each round. Links with a null end or equal ends say nothing.
    """
    low, high = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    edges = links.where(F.col(a) != F.col(b)).select(low, high).distinct().checkpoint()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.least(F.min("hi"), F.col("lo")).alias("m"))
        large = both.where("hi > lo").join(least, "lo").select(F.col("m").alias("lo"), "hi").distinct()
        top = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(top, "hi").select(
            F.explode(F.array(F.struct(F.col("m").alias("lo"), "hi"),
                              F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e"))
        edges = small.select("e.lo", "e.hi").where("lo < hi").distinct().checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
