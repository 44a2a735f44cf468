"""Connected components of an edge table (R6): labels travel over edges and over labels, a round at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.stages import Stages


def _round(edges: DataFrame) -> DataFrame:
    """One round on edges (u, v): every node hangs its larger neighbours, then itself and the smaller ones, on the least it knows.

    Least neighbours come from aggregates, so a node with many edges leaves one row a task; its edges then meet that
    one row, which adaptive execution splits where they are many.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = hung.groupBy("u").agg(F.min("v").alias("m"))
    return hung.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(stages: Stages, edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) reaches, itself included; nodes are of any orderable type.

    Paths shrink by a constant factor a round, so a path of ten thousand takes some ten rounds. Each round's edges, never more than those
    given, are written and read back, and the driver only learns whether a node is left that isn't settled.
    """
    edges, k = stages.save(edges.filter("u <> v").distinct(), f"{name}-0"), 0
    while not _settled(edges):
        k += 1
        edges = stages.save(_round(edges), f"{name}-{k}")
        stages.drop(f"{name}-{k - 1}")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def equivalence_clusters(stages: Stages, answers: DataFrame, edges: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, answer, cluster), the least answer that each reaches over equivalences (key, a, b) within its key.

    Answers of a key may be any number: neither they nor their edges are gathered in a row. Edges with an end that is no
    answer of the key lead nowhere; an answer without edges is its own cluster. Repeated answers and edges count once.
    """
    nodes = stages.save(answers.select(key, F.col(answer).alias("_a")).distinct(), "answers")
    node = lambda c: F.struct(F.col(key).alias("key"), F.col(c).alias("answer"))
    known = lambda side: nodes.select(F.col(key), F.col("_a").alias(side))
    linked = edges.select(key, "a", "b").filter("a <> b").join(known("a"), [key, "a"], "left_semi").join(known("b"), [key, "b"], "left_semi")
    found = components(stages, linked.select(node("a").alias("u"), node("b").alias("v")))
    found = found.select(F.col("node.key").alias(key), F.col("node.answer").alias("_a"), F.col("component.answer").alias("cluster"))
    return nodes.join(found, [key, "_a"], "left").select(key, F.col("_a").alias(answer), F.coalesce("cluster", "_a").alias("cluster"))
