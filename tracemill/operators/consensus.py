"""Questions across models (J3-J8, R10) and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the last by ``order``; an aggregate, so that a frequent key is combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def common_questions(traces: DataFrame, models: int | None = None) -> DataFrame:
    """Questions that every model has answered; the number of models is counted unless given."""
    if models is None:
        total = traces.agg(F.count_distinct("model_name").alias("models"))
        counted = traces.groupBy("question_id").agg(F.count_distinct("model_name").alias("n")).crossJoin(F.broadcast(total))  # one row
        return counted.filter("n = models").select("question_id")
    return traces.groupBy("question_id").agg(F.count_distinct("model_name").alias("n")).filter(F.col("n") == models).select("question_id")


def question_profiles(traces: DataFrame) -> DataFrame:
    """Per question who was right and who was wrong, and its difficulty: easy, hard or mixed."""
    right = F.col("is_correct")
    out = traces.groupBy("question_id").agg(
        F.count_if(right).alias("n_correct"), F.count_if(~right).alias("n_wrong"),
        F.array_sort(F.collect_list(F.when(right, F.col("model_name")))).alias("correct_models"),
        F.array_sort(F.collect_list(F.when(~right, F.col("model_name")))).alias("wrong_models"),
    )
    return out.withColumn("difficulty", F.when(F.col("n_wrong") == 0, "easy").when(F.col("n_correct") == 0, "hard").otherwise("mixed"))


def agreement(traces: DataFrame) -> DataFrame:
    """Share of common questions on which two models are both right or both wrong, for all ordered pairs.

    A question's answers meet in one row (as many as there are models) and give its pairs; no join.
    """
    rows = traces.groupBy("question_id").agg(F.collect_list(F.struct("model_name", "is_correct")).alias("a"))
    pairs = rows.select(F.explode("a").alias("x"), "a").select("x", F.explode("a").alias("y"))
    return pairs.groupBy(F.col("x.model_name").alias("model_1"), F.col("y.model_name").alias("model_2")).agg(
        F.avg((F.col("x.is_correct") == F.col("y.is_correct")).cast("double")).alias("agreement"), F.count("*").alias("n_common")
    )


def majority(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """Most frequent answer, the smallest on ties, with its share."""
    votes = answers.groupBy(key, answer).agg(F.count("*").alias("votes"))
    best = votes.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("less"), F.col(answer).alias("answer"))).alias("b"), F.sum("votes").alias("total"))
    return best.select(key, F.col("b.answer").alias("majority"), (-F.col("b.less")).alias("votes"), (-F.col("b.less") / F.col("total")).alias("share"))


def semantic_entropy(answers: DataFrame, key: str, cluster: str) -> DataFrame:
    """Entropy of a question's answers over given meaning clusters."""
    n = answers.groupBy(key, cluster).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return n.withColumn("h", -p * F.ln(p)).groupBy(key).agg(F.sum("h").alias("entropy"), F.count("*").alias("n_clusters"))


def run_summary(traces: DataFrame, **more: Column) -> DataFrame:
    """Per model the traces, right, parsed and failed ones and the mean characters of thinking; ``more`` aggregates may be added."""
    return traces.groupBy("model_name").agg(
        F.count("*").alias("n_traces"), F.count_if("is_correct").alias("n_correct"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"),
        F.count("predicted_option").alias("n_parsed"), F.count_if(F.col("raw_output").startswith("ERROR")).alias("n_errors"), F.avg("thinking_chars").alias("mean_chars"),
        *[c.alias(k) for k, c in more.items()],
    )


def cost_ratio(traces: DataFrame, one: str) -> DataFrame:
    """Time of a question's runs by all models over that by one model."""
    return traces.groupBy("question_id").agg(F.sum("seconds").alias("all_s"), F.sum(F.when(F.col("model_name") == one, F.col("seconds"))).alias("one_s")).select(
        "question_id", "all_s", "one_s", F.try_divide("all_s", "one_s").alias("ratio")
    )
