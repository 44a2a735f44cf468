"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch, if_few


def _least(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest of each node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))


def _unsettled(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges that don't hang a node, as its only parent, on one that has no smaller neighbour. Without any, ``least`` is the result."""
    of = lambda c: least.select(F.col("node").alias(c), F.col("component").alias(f"{c}_least"))
    return edges.join(of("u"), "u").join(of("v"), "v").filter("u_least <> v or v_least <> v")


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node that it knows."""
    return edges.join(least, edges["v"] == least["node"]).select("u", F.col("component").alias("v"))


def _small_star(down: DataFrame, hint, packed) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them."""
    least = hint(packed(down.groupBy("u").agg(F.min("v").alias("m"))))
    hung = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return hung.filter("u <> v").distinct()


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches.

    Every round writes its edges and each node's smallest neighbour to the shared folder, so lineage stays short, and the
    driver only learns whether an edge is left that isn't settled. Ends when all edges are stars around the smallest
    node. Edges are counted: smallest neighbours over few of them go out as a broadcast, so that a round shuffles only to
    aggregate, and few tasks read these shuffles.
    """
    edges, k = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), 0
    hint, packed = if_few(edges, 2)
    while True:
        least = scratch.save(packed(_least(edges)), f"{name}-least-{k}")
        if _unsettled(edges, hint(least)).isEmpty():
            break
        edges = scratch.save(packed(_small_star(_large_star(edges, hint(least)), hint, packed)), f"{name}-{k}")
        scratch.drop(f"{name}-least-{k}", *[f"{name}-{k - 1}"] * (k > 0))
        k += 1
    if k:
        scratch.drop(f"{name}-{k - 1}")
    return least
