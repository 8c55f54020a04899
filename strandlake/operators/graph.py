"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.plans.shared import discard, written


def _jumped(parents: DataFrame) -> DataFrame:
    """Follow parents to the roots: each pass doubles the steps behind a pointer."""
    while True:
        up = parents.select(F.col("node").alias("_up"), F.col("parent").alias("_root"))
        after = parents.join(up, parents["parent"] == up["_up"], "left")
        after = written(
            after.select("node", F.coalesce("_root", "parent").alias("parent"), (F.col("_root") < F.col("parent")).alias("_moved")), "jump"
        )
        discard(parents)
        parents, moved = after, after.where("_moved").limit(1).count()
        if not moved:
            return after


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Contraction: each node hooks to its least neighbour, pointers are followed to the
    roots, and the edges between different roots are the next round's graph. Every round
    leaves at most half of the nodes, so rounds are logarithmic whatever the graph's
    diameter. Tables are written to the shared folder after each step; joins read
    them directly, so adaptive execution can split a hub's rows. Edges with a null
    end are ignored, self-loops give a node of its own.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    pairs = written(pairs.distinct(), "edges")
    rounds: list[DataFrame] = []
    while pairs.limit(1).count():
        near = pairs.select(F.col("b").alias("node"), F.col("a").alias("parent")).unionAll(pairs.select(F.col("a").alias("node"), F.col("a").alias("parent")))
        parents = _jumped(written(near.groupBy("node").agg(F.min("parent").alias("parent")), "hook")).drop("_moved")
        rounds.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("_pa"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("_pb"))
        moved = pairs.join(left, "a").select("b", "_pa").join(right, "b").where(F.col("_pa") != F.col("_pb"))
        after = written(moved.select(F.least("_pa", "_pb").alias("a"), F.greatest("_pa", "_pb").alias("b")).distinct(), "contracted")
        discard(pairs)
        pairs = after
    if not rounds:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("component"))
    out = rounds[-1].select("node", F.col("parent").alias("component"))
    for parents in reversed(rounds[:-1]):
        root = out.select(F.col("node").alias("_root"), "component")
        out = written(parents.join(root, parents["parent"] == root["_root"], "left").select("node", F.coalesce("component", "parent").alias("component")), "labels")
    return out
