"""What Python workers are given: batches bounded by bytes, and as few passes as there are steps."""

import pandas as pd
from pyspark.sql import functions as F

from tracemill.jobs import outputs
from tracemill.operators.outputs import split_outputs

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_by_bytes(spark):
    spark.conf.unset(KEY)
    rows = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.lit("m").alias("model_name"), F.repeat(F.lit("x"), F.lit(100_000)).alias("raw_output"))
    split_outputs(rows.limit(1))

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    assert rows.select(size("raw_output").alias("n")).agg(F.max("n")).first()[0] < 8_000_000


def test_passes_of_outputs(spark):
    for job in ("run_summary", "model_outputs"):
        plan = outputs.QUERIES[job](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 3
