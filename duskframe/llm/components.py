"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _flatten(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Point every node at the end of its chain of parents, by doubling."""
    while True:
        up = parents.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        after = scratch.save(parents.join(up, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")))
        scratch.drop(parents)
        parents = after
        if not parents.filter("moved").limit(1).count():
            return parents.select("node", "root")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not the least of its component.

    Each round hooks every node to its least smaller neighbour, follows the hooks to their ends, and keeps
    the edges between different ends. Rounds and doublings are logarithmic; edges and nodes stay on the
    executors; a node with very many edges only ever meets partial minima.
    """
    found = None
    left = scratch.save(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct())
    while left.limit(1).count():
        hooks = scratch.save(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        path = _flatten(hooks, scratch)
        ends = path.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        found = path if found is None else scratch.save(found.join(ends, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root")).unionByName(path))
        half = left.join(ends, F.col("lo") == F.col("__node"), "left").select(F.coalesce("__root", "lo").alias("lo"), "hi")
        whole = half.join(ends, F.col("hi") == F.col("__node"), "left").select("lo", F.coalesce("__root", "hi").alias("hi"))
        left = scratch.save(whole.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).filter("lo < hi").distinct())
    return found if found is not None else left.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
