"""Connected components of a distributed edge table, for near-duplicate groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_by_key, materialize, release


class Forest:
    """Union-find over integers, for one task: it turns many links into few."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            a, b = (a, b) if a < b else (b, a)
            self.up.setdefault(a, a)
            self.up[b] = a

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        """Every node that isn't the smallest of its group, and that smallest node."""
        nodes = [x for x in list(self.up) if self.root(x) != x]
        return np.array(nodes, np.int64), np.array([self.root(x) for x in nodes], np.int64)


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``: long): the smallest node it reaches.

    Large-star and small-star rounds over data frames: each round links every node
    to the smallest of its neighbours, and ends when nothing changes.  A round is
    written to the shared folder, so the plan stays short and no link is ever
    collected; the nodes that most links meet at are joined by broadcast.  An empty table
    gives an empty table; self links count for nothing.  Rounds grow with the logarithm
    of the longest path; after ``max_rounds`` without an end, a RuntimeError is raised.
    """
    spark = edges.sparkSession
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        at = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (at.n, at.s) == mark or at.n == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        mark = (at.n, at.s)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_by_key(both, least, "a", "n", 2 * at.n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_by_key(large, least, "a", "n", at.n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", "m")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = materialize(small, "links")
        release(spark)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
