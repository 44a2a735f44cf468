"""What must hold at any size: ties of millions, long traces, one split per plan, quantiles without group buffers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.jobs import outputs, sentences, texts
from tracemill.operators import comparison, coupling, curves
from tracemill.operators.ranks import quantiles, rank_sums


def test_three_million_ties(spark):
    df = spark.range(3_000_000).select(F.lit("g").alias("g"), F.lit(4).alias("x"), (F.col("id") % 3 == 0).alias("y"))
    r = rank_sums(df, ["g"], "x", "y").first()
    assert (r.n1, r.n0) == (1_000_000, 2_000_000) and r.u == 1e6 * 2e6 / 2 and r.ties == pytest.approx(3e6**3 - 3e6)
    long = df.select("g", F.lit("f").alias("feature"), F.col("y").alias("is_correct"), F.col("x").cast("double").alias("value"))
    p = comparison.with_p(comparison.group_comparison(long, ["g"])).first()
    assert p.p == 1.0 and p.cohens_d == 0.0 and p.correct_std == 0.0


def test_long_trace(spark):
    n = 200_000
    curve = spark.range(n).select(F.lit("a").alias("q"), F.col("id").alias("idx"), F.when(F.col("id") < n - 7, 0.5).otherwise(0.9).alias("sim"))
    assert curves.commitment(curve, ["q"], 0.8, None).first().commitment_point == n - 7
    assert {(r.tau, r.commitment_point) for r in curves.commitment_sweep(curve, ["q"], [0.4, 0.8, 0.95]).collect()} == {(0.4, 0), (0.8, n - 7), (0.95, -1)}
    marks = curve.select("q", F.col("idx").alias("pos"), F.lit("hedge").alias("category"))
    turns = spark.createDataFrame([("a", 5), ("a", n - 1)], "q string, pos long")
    events = coupling.coupling_events(marks, turns, spark.createDataFrame([("a", n)], "q string, n_sentences long"), ["q"])
    assert events.agg(F.count("*"), F.min("distance"), F.max("distance")).first() == (n - 1, 1, n - 1 - 5)


def test_quantiles(spark):
    rng = random.Random(7)
    made = {g: [rng.choice([rng.random(), float(rng.randrange(5))]) for _ in range(k)] for g, k in (("a", 1), ("b", 2), ("c", 3001))}
    df = spark.createDataFrame([(g, v) for g, c in made.items() for v in c], "g string, v double")
    shares = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q": 0.67, "hi": 1.0}
    for r in quantiles(df, ["g"], "v", shares).collect():
        for k, q in shares.items():
            assert r[k] == pytest.approx(np.quantile(made[r.g], q), abs=1e-12)


def test_group_moments(spark):
    rng = random.Random(8)
    rows = [(f, rng.random() < 0.4, base + rng.random() * spread) for f, base, spread in (("near", 0.0, 1.0), ("far", 1e6, 1.0), ("wide", -50.0, 1e5)) for _ in range(400)]
    long = spark.createDataFrame([("m", *r) for r in rows], "m string, feature string, is_correct boolean, value double")
    for r in comparison.group_comparison(long, ["m"]).collect():
        one, zero = ([v for f, y, v in rows if f == r.feature and y is k] for k in (True, False))
        assert (r.n_correct, r.n_incorrect) == (len(one), len(zero))
        pooled = np.sqrt(((len(one) - 1) * np.var(one, ddof=1) + (len(zero) - 1) * np.var(zero, ddof=1)) / (len(one) + len(zero) - 2))
        want = [np.mean(one), np.std(one), np.mean(zero), np.std(zero), (np.mean(one) - np.mean(zero)) / pooled]
        assert [r.correct_mean, r.correct_std, r.incorrect_mean, r.incorrect_std, r.cohens_d] == pytest.approx(want, rel=1e-7)


@pytest.mark.parametrize("job", ["sentences", "sentence_states", "step_density"])
def test_texts_are_split_once(spark, job):
    plan = texts.QUERIES[job](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    cuts = plan.count("split(regexp_replace")  # the cut to sentences; list items are cut from those
    assert cuts == 1


@pytest.mark.parametrize("job,scans", [("marker_calibration", 2), ("feature_comparison", 1)])
def test_ranks_read_their_rows_once(spark, job, scans):
    df = (texts.QUERIES | __import__("tracemill.jobs.analysis", fromlist=["QUERIES"]).QUERIES)[job](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == scans


@pytest.mark.parametrize("job", ["text_coupling", "text_coupling_lift", "sentence_trajectories", "sentence_contexts"])
def test_a_query_splits_its_texts_before_all_else(spark, job):
    """The sentences are read back from the table that the query has written: its plan holds no split."""
    plan = sentences.QUERIES[job](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_graded_plan_is_short(spark):
    """No step of T1-T4 is copied into its users: the plan that runs stays below 100 KB."""
    for job in ("graded_traces", "model_outputs", "run_summary"):
        assert len(outputs.QUERIES[job](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()) < 100_000
