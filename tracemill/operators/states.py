"""Epistemic state trajectories (E1-E8). Input is long: keys, pos (0, 1, ...), state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.config import ALL_STATES, NEUTRAL


def trajectories(states: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of the states, last state that isn't neutral, place of the first commitment, exploring before it.

    One aggregate per trace after one window. The cut is the integer part of a float product, as i / n * n may fall
    just short of i.
    """
    whole = Window.partitionBy(*keys)
    rows = states.withColumns({"n": F.count("*").over(whole), "first": F.min(F.when(F.col("state") == "committing", F.col("pos"))).over(whole)})
    rows = rows.withColumn("first_commit_position", F.coalesce(F.col("first") / F.col("n"), F.lit(1.0)))
    rows = rows.withColumn("cut", (F.col("first_commit_position") * F.col("n")).cast("int"))
    share = lambda s: F.avg((F.col("state") == s).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_sentences"),
        *[share(s).alias(f"{s}_ratio") for s in ALL_STATES],
        F.coalesce(F.max_by("state", F.when(F.col("state") != NEUTRAL, F.col("pos"))), F.lit(NEUTRAL)).alias("final_state"),
        F.max("first_commit_position").alias("first_commit_position"),
        (F.count_if((F.col("state") == "exploring") & (F.col("pos") < F.col("cut"))) / F.greatest(F.max("cut"), F.lit(1))).alias("explore_before_commit"),
    )


def transition_matrix(states: DataFrame, keys: list[str]) -> DataFrame:
    """Per trace all 25 cells of P(next | state); rows of states that are never left are 0."""
    nxt = F.lead("state").over(Window.partitionBy(*keys).orderBy("pos"))
    pairs = states.withColumn("next", nxt).filter("next is not null")
    cells = [(a, b) for a in ALL_STATES for b in ALL_STATES]
    counts = pairs.groupBy(*keys).agg(
        *[F.count_if((F.col("state") == a) & (F.col("next") == b)).alias(f"{a}>{b}") for a, b in cells]
    )
    table = F.array(*[
        F.struct(F.lit(a).alias("state"), F.lit(b).alias("next"), F.coalesce(F.try_divide(F.col(f"`{a}>{b}`"), sum((F.col(f"`{a}>{x}`") for x in ALL_STATES), F.lit(0))), F.lit(0.0)).alias("p"))
        for a, b in cells
    ])
    return counts.select(*keys, F.explode(table).alias("cell")).select(*keys, "cell.*")


def final_state_counts(traces: DataFrame, group: list[str]) -> DataFrame:
    """E7."""
    return traces.groupBy(*group, "final_state").agg(F.count("*").alias("n"))
