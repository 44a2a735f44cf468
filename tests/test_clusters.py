"""Clusters of any number of answers."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import clusters
from tracemill.stages import Stages, settled, shared_folder


@pytest.mark.parametrize("n", [20, 40, 10_000])
def test_a_path_is_one_cluster(spark, n):
    """Neighbours on the path have numbers far from each other, so no order of labels helps."""
    order = list(range(n))
    random.Random(n).shuffle(order)
    edges = spark.createDataFrame([("q", a, b) for a, b in zip(order, order[1:])], "q string, a long, b long")
    answers = spark.createDataFrame([("q", a) for a in order] + [("r", 5), ("r", 6)], "q string, x long")
    with Stages(spark, "path") as stages:
        got = clusters.equivalence_clusters(stages, answers, edges, "q", "x").groupBy("q").agg(F.count("*").alias("n"), F.collect_set("cluster").alias("c")).collect()
    assert {r.q: (r.n, sorted(r.c)) for r in got} == {"q": (n, [0]), "r": (2, [5, 6])}


def test_a_large_key_is_never_one_row(spark):
    """100,000 answers of one key: no plan of a round gathers values of a key."""
    n = 100_000
    ids = spark.range(n).select(F.lit("q").alias("q"), F.col("id").alias("x"))
    edges = spark.range(n - 1).filter("id % 100 <> 99").select(F.lit("q").alias("q"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with Stages(spark, "large") as stages:
        df = clusters.equivalence_clusters(stages, ids, edges, "q", "x")
        assert "collect" not in df._jdf.queryExecution().toString()
        assert df.filter("cluster <> x - x % 100").isEmpty() and df.count() == n


def test_random_edges_against_union_find(spark):
    rng = random.Random(4)
    answers = [(k, a) for k in range(6) for a in range(40)] + [(None, 1), (3, None)]
    edges = [(k, rng.randrange(45), rng.randrange(45)) for k in range(6) for _ in range(8 * k)] * 2
    parent = {x: x for x in answers}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a, b in edges:
        if a < 40 and b < 40:
            x, y = sorted((root((k, a)), root((k, b))))
            parent[y] = x
    with Stages(spark, "random") as stages:
        got = clusters.equivalence_clusters(stages, spark.createDataFrame(answers, "q long, x long"), spark.createDataFrame(edges, "q long, a long, b long"), "q", "x").collect()
    want = {(k, a): (root((k, a))[1] if k is not None and a is not None else a) for k, a in answers}
    assert {(r.q, r.x): r.cluster for r in got} == want and len(got) == len(answers)


def test_no_edges(spark):
    with Stages(spark, "none") as stages:
        none = spark.createDataFrame([], "q string, a long, b long")
        assert clusters.equivalence_clusters(stages, spark.createDataFrame([], "q string, x long"), none, "q", "x").count() == 0


def test_stages_are_closed(spark):
    with Stages(spark, "closed") as stages:
        assert stages.save(spark.range(3), "t").count() == 3
        root = stages.root
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    assert root.startswith(shared_folder(spark)) and not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_settled_columns_stand_once_in_a_plan(spark):
    df = spark.range(5).withColumn("t", F.concat(F.lit("a-marker-of-the-plan"), F.col("id").cast("string")))
    df = settled(df, u=F.upper(F.concat("t", F.lit("once"))))
    df = df.filter("u like '%1%' or u like '%2%'").select(*[F.concat("u", F.lit(str(i))).alias(f"c{i}") for i in range(20)])
    assert df._jdf.queryExecution().executedPlan().toString().count("once") <= 2 and df.count() == 2
