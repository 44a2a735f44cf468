"""Markers and the transitions that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.config import PARAMS


def coupling_events(markers: DataFrame, transitions: DataFrame, sizes: DataFrame | None, keys: list[str]) -> DataFrame:
    """Each marker (keys, pos, category) with the nearest transition (keys, pos) strictly after it in its trace.

    Markers and transitions are one table, read from the end of the trace; a running minimum over the rows of larger places
    is the next transition, so the join costs one sort per trace and a step per row. Markers without a later transition and traces without any (J1) drop out. ``sizes``
    (keys, n_sentences) gives the traces that are long enough; without it, markers have that column themselves.
    """
    none = lambda kind: F.lit(None).cast(kind)
    n = none("long") if sizes is not None else F.col("n_sentences").cast("long")
    both = markers.select(*keys, "pos", "category", n.alias("n_sentences"), none("long").alias("at")).unionByName(
        transitions.select(*keys, "pos", none("string").alias("category"), none("long").alias("n_sentences"), F.col("pos").cast("long").alias("at"))
    )
    later = Window.partitionBy(*keys).orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("next_at", F.min("at").over(later)).filter("category is not null and next_at is not null")
    if sizes is not None:
        found = found.drop("n_sentences").join(sizes.select(*keys, "n_sentences"), keys)
    return found.filter(F.col("n_sentences") >= PARAMS.coupling_sentences).select(
        *keys, "category", (F.col("pos") / F.col("n_sentences")).alias("marker_position"),
        (F.col("next_at") - F.col("pos")).alias("distance"), ((F.col("next_at") - F.col("pos")) / F.col("n_sentences")).alias("distance_normalized"),
    )


def coupling_summary(events: DataFrame, group: list[str]) -> DataFrame:
    """G12."""
    close = F.count_if(F.col("distance") <= PARAMS.near)
    return events.groupBy(*group, "category").agg(
        F.count("*").alias("n_events"), F.avg("distance").alias("mean_distance"), close.alias("within_near"), (100.0 * close / F.count("*")).alias("pct_within_near")
    )


def lift_over_chance(summary: DataFrame, sizes: DataFrame, group: list[str], category: str = "revise") -> DataFrame:
    """Share of a category's markers close to a transition against 3 / mean trace length."""
    chance = sizes.groupBy(*group).agg((100.0 * PARAMS.near / F.avg("n_sentences")).alias("chance_pct"))
    out = summary.filter(F.col("category") == category).join(chance, group)
    return out.select(*group, "pct_within_near", "chance_pct", (F.col("pct_within_near") / F.greatest("chance_pct", F.lit(0.1))).alias("lift"), (F.col("pct_within_near") > 2 * F.col("chance_pct")).alias("strong"))
