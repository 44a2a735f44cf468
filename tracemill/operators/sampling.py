"""Samples that reruns repeat (P1, R13) and reasoning steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that open a new reasoning step.
PIVOTS = ["However", "Alternatively", "Wait", "Actually", "But", "Therefore", "So", "Let me", "Hmm", "Next", "Finally"]


def turn(key: str, seed: int) -> Column:
    """Place of a row in the seeded order: a hash of its key."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def fixed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows, or all if there are no more; a top-n by hash, so no task holds more than n rows of another."""
    return df.orderBy(turn(key, seed), key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """N rows of each stratum, the first by hash.

    A stratum may be a third of all rows: each is dealt to 64 cells by its hash first, cells keep n rows, and only those
    compete in the stratum.
    """
    rows = df.withColumn("_turn", turn(key, seed)).withColumn("_cell", F.substring("_turn", 31, 2))
    cell = F.row_number().over(Window.partitionBy(stratum, "_cell").orderBy("_turn", key))
    rows = rows.withColumn("_k", cell).filter(F.col("_k") <= n)
    best = F.row_number().over(Window.partitionBy(stratum).orderBy("_turn", key))
    return rows.withColumn("_k", best).filter(F.col("_k") <= n).drop("_turn", "_cell", "_k")


def reasoning_steps(text: Column, min_words: int = 10) -> Column:
    """Steps that begin at pivots or blank lines and have at least ``min_words`` words."""
    parts = F.split(text, r"\n\s*\n|\s+(?=(?:" + "|".join(PIVOTS) + r")\b)", -1)
    return F.filter(parts, lambda s: F.regexp_count(s, F.lit(r"\S+")) >= min_words)


def abandoned(text: Column, phrase: str = r"I (?:initially|first) thought\b.{0,200}?\bbut\b") -> Column:
    """Number of branches that the writer gave up."""
    return F.coalesce(F.regexp_count(text, F.lit(f"(?is){phrase}")), F.lit(0))


def abandoned_share(traces: DataFrame, text: str, group: list[str]) -> DataFrame:
    """Traces of each group, their abandoned branches, and the share of traces that have one; a null text has none."""
    n = F.coalesce(abandoned(F.col(text)), F.lit(0))
    return traces.groupBy(*group).agg(F.count("*").alias("n_traces"), F.sum(n).cast("long").alias("n_abandoned"), F.avg((n > 0).cast("double")).alias("share_abandoned"))
