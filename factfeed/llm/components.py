"""Connected components of a graph of any size, smallest member as the name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfeed.session import materialize

from .common import map_batches


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of `edges` (a, b), whose order is free.

    Each task first replaces its edges by stars (a union-find over one partition).
    Then large-star and small-star steps alternate until all links form stars:
    every node's larger neighbours, then its smaller ones, are linked to its
    smallest neighbour. A node's minimum is aggregated before the join, so that a
    centre with very many neighbours is a join Spark can split, never one group.
    """
    now = materialize(_stars(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))).distinct(), "links")
    while _tangled(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "links")
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        joined = large.join(least, "hi")
        small = joined.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo")))
        now = materialize(small.distinct(), "links")
    centres = now.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(centres)


def _tangled(links: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one."""
    ends = links.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] is True


def _stars(edges: DataFrame) -> DataFrame:
    def make():
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        def step(batch):
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)

        def finish():
            hi = np.fromiter(parent, np.int64, len(parent))
            lo = np.array([root(x) for x in list(parent)], np.int64)
            for i in range(0, len(hi), 100_000):
                yield [pa.array(hi[i : i + 100_000]), pa.array(lo[i : i + 100_000])]

        return step, finish

    return map_batches(edges.where("a != b"), make, "hi: long, lo: long")
