"""The 60 graded traces of FIXTURES.md and small hand-made sets."""

import csv
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracemill.operators import consensus
from tracemill.operators import comparison as G

TEXT = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()


@pytest.fixture(scope="module")
def graded(spark):
    rows = list(csv.DictReader(io.StringIO(TEXT.split("```csv\n")[1].split("```")[0])))
    df = spark.createDataFrame(rows).withColumns({
        "is_correct": F.col("is_correct") == "true", "predicted_option": F.when(F.col("predicted") != "", F.col("predicted")), "thinking_chars": F.col("thinking_chars").cast("int"),
        "raw_output": F.lit("text"), "seconds": F.col("generation_time_s").cast("double"),
    })
    return df.cache()


def test_run_summary(graded):
    got = {r.model_name: (r.n_traces, r.n_correct, r.n_parsed, round(r.mean_chars), r.n_errors) for r in consensus.run_summary(graded).collect()}
    assert got == {"qwq-32b": (20, 15, 20, 6052, 0), "qwen3-8b": (20, 11, 17, 4844, 0), "qwen3-4b-thinking": (20, 10, 18, 10674, 0)}


def test_profiles(graded):
    assert consensus.common_questions(graded).count() == consensus.common_questions(graded, 3).count() == 20
    by = {}
    for r in consensus.question_profiles(graded).collect():
        by.setdefault(r.difficulty, []).append(r.question_id[-4:])
    assert sorted(by["easy"]) == "0051 0054 0065 0209 0476 0563 0864 1232".split()
    assert sorted(by["hard"]) == "0178 0285 1116 1149".split() and len(by["mixed"]) == 8


def test_agreement(graded):
    got = {(r.model_1, r.model_2): round(r.agreement, 6) for r in consensus.agreement(graded).collect()}
    a, b, c = "qwq-32b", "qwen3-8b", "qwen3-4b-thinking"
    assert got[a, b] == got[b, a] == 0.7 and got[a, c] == got[b, c] == 0.75 and got[a, a] == 1.0 and len(got) == 9


def test_cost(graded):
    total = consensus.cost_ratio(graded, "qwq-32b").agg(F.sum("all_s"), F.sum("one_s")).first()
    assert total[0] == pytest.approx(6269.0 + 4261.7 + 10207.2, abs=0.2) and total[1] == pytest.approx(6269.0, abs=0.1)


def test_last_rows_and_majority(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "b", 2), (2, "c", 1), (2, "d", 1)], "k int, v string, t int")
    assert {(r.k, r.v) for r in consensus.last_rows(df, ["k"], ["t", "v"]).collect()} == {(1, "b"), (2, "d")}
    assert {(r.k, r.majority, r.share) for r in consensus.majority(df, "k", "v").collect()} == {(1, "b", 2 / 3), (2, "c", 0.5)}
    assert {r.k: r.n_clusters for r in consensus.semantic_entropy(df, "k", "v").collect()} == {1: 2, 2: 2}


def test_scores(spark):
    df = spark.createDataFrame([("a", 0.9, True), ("a", 0.8, True), ("a", 0.8, False), ("a", 0.1, False), ("b", 0.5, True)], "m string, p double, y boolean")
    got = {r.m: r.auroc for r in G.auroc(df, ["m"], "p", "y").collect()}
    assert got["a"] == pytest.approx(3.5 / 4) and got["b"] is None
    assert {r.m: r.brier for r in G.calibration_error(df, ["m"], "p", "y").collect()}["b"] == pytest.approx(0.25)
    found, truth = spark.createDataFrame([(1, 1), (1, 2)], "m int, i int"), spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "m int, i int")
    r = G.detection_quality(found, truth, ["m", "i"], ["m"]).first()
    assert (r.hits, r.precision, r.recall) == (1, 0.5, pytest.approx(1 / 3))
    pairs = spark.createDataFrame([(1, "x", "x"), (1, "x", "y"), (1, "y", "y"), (1, "y", "y"), (2, "x", "x")], "m int, a string, b string")
    k = {r.m: r.kappa for r in G.kappa(pairs, "a", "b", ["m"]).collect()}
    assert k[1] == pytest.approx((0.75 - 0.5) / 0.5) and k[2] == 1.0
