"""Prompts over a table that grows."""

from tracemill.jobs import texts


def test_prompts_grow(spark):
    n = {}
    for sf in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{sf}"
        n[sf] = texts.trace_prompts(spark, folder).count()
        assert n[sf] == spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id div 3 as q").distinct().count()
    assert n["sf0.01"] > n["sf0.001"]
