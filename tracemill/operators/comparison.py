"""Group comparisons, calibration and agreement measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.config import PARAMS
from tracemill.functions.stats import mann_whitney_p_udf, spearman_p_udf
from tracemill.operators.ranks import average_ranks, quantiles, rank_sums, spearman, ties, u_statistic
from tracemill.session import ship_package


def long_features(features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per trace and feature; -1 stands for "none" in any feature and is left out."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in names])
    return features.select(*keys, "is_correct", F.explode(cells).alias("cell")).select(*keys, "is_correct", "cell.*").filter("value is not null and value <> -1")


def cohens_d(n1: Column, m1: Column, v1: Column, n0: Column, m0: Column, v0: Column, floor: float | None = None) -> Column:
    """Difference of means over the pooled sample deviation; 0 if a group has under 2 values or the deviation is 0.

    With ``floor`` the deviation is at least that much instead.
    """
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n0 - 1) * v0, (n1 + n0 - 2).cast("double")))
    by = pooled if floor is None else F.greatest(pooled, F.lit(floor))
    return F.when((n1 < 2) | (n0 < 2), 0.0).otherwise(F.coalesce(F.try_divide(m1 - m0, F.when(by > 0, by)), F.lit(0.0)))


def group_comparison(long: DataFrame, group: list[str], floor: float | None = None) -> DataFrame:
    """G2-G4 but p: per group and feature the means, population deviations, d and the U statistic of right traces.

    All of it comes from the rows of ``average_ranks`` (one per distinct value), so features are computed once. Moments are
    taken around a value in the middle of the group; a side whose values are all equal has deviation 0.
    """
    keys = [*group, "feature"]
    v = F.col("value") - F.col("mid")
    side = {"correct": F.col("ones"), "incorrect": F.col("n") - F.col("ones")}
    sums = {}
    for name, w in side.items():
        mine = F.when(w > 0, F.col("value"))
        sums |= {f"n_{name}": F.sum(w), f"s_{name}": F.sum(v * w), f"q_{name}": F.sum(v * v * w), f"same_{name}": F.min(mine) == F.max(mine)}
    ranks = average_ranks(long, keys, "value", {"ones": F.col("is_correct").cast("int")})
    out = ranks.groupBy(*keys).agg(*[c.alias(k) for k, c in sums.items()], F.max("mid").alias("mid"), u_statistic().alias("u"), ties(F.col("n")).alias("ties"))
    for name in side:
        n, s, q = F.col(f"n_{name}"), F.col(f"s_{name}"), F.col(f"q_{name}")
        spread = F.when(F.col(f"same_{name}"), 0.0).otherwise(F.greatest(q - F.try_divide(s * s, n), F.lit(0.0)))
        out = out.withColumns({
            f"{name}_mean": F.col("mid") + F.try_divide(s, n), f"{name}_std": F.sqrt(F.try_divide(spread, n)), f"v_{name}": F.try_divide(spread, n - 1),
        })
    d = cohens_d(F.col("n_correct"), F.col("correct_mean"), F.col("v_correct"), F.col("n_incorrect"), F.col("incorrect_mean"), F.col("v_incorrect"), floor)
    return out.withColumn("cohens_d", d).select(*keys, "n_correct", "n_incorrect", "correct_mean", "correct_std", "incorrect_mean", "incorrect_std", "cohens_d", "u", "ties")


def group_sizes(features: DataFrame, group: list[str]) -> DataFrame:
    """Traces per group and side, with the warning that keeps a group out of the tests.

    A group with fewer than ``min_traces`` traces is ``too_few_traces``, one with fewer than two on a side
    ``insufficient_group_size``.
    """
    n = features.groupBy(*group).agg(F.count_if("is_correct").alias("n_correct"), F.count_if(~F.col("is_correct")).alias("n_incorrect"))
    warning = F.when(F.col("n_correct") + F.col("n_incorrect") < PARAMS.min_traces, "too_few_traces").when(F.least("n_correct", "n_incorrect") < 2, "insufficient_group_size")
    return n.withColumn("warning", warning)


def enough_traces(features: DataFrame, group: list[str]) -> DataFrame:
    """The rows of groups without a warning."""
    return features.join(group_sizes(features, group).filter("warning is null").select(*group), group, "left_semi")


def with_p(comparison: DataFrame) -> DataFrame:
    """Adds the Mann-Whitney p, whether it is significant, and a note where a group is too small."""
    ship_package(comparison.sparkSession)
    out = comparison.withColumn("p", mann_whitney_p_udf()("u", "n_correct", "n_incorrect", "ties"))
    small = (F.col("n_correct") < 2) | (F.col("n_incorrect") < 2)
    return out.withColumns({"significant": ~small & (F.col("p") < PARAMS.p), "note": F.when(small, "insufficient_data")})


def marker_correlations(long: DataFrame, group: list[str]) -> DataFrame:
    """Correlation of density with error, mean densities by correctness, and whether |rho| passes."""
    rho = spearman(long, group, "density", "is_error")
    means = {"mean_density_correct": F.coalesce("mean_0", F.lit(0.0)), "mean_density_incorrect": F.coalesce("mean_1", F.lit(0.0))}
    return rho.withColumns(means).drop("mean_0", "mean_1").withColumn("passes_rho", F.abs("rho") > PARAMS.rho)


def with_rho_p(correlations: DataFrame) -> DataFrame:
    """G7."""
    ship_package(correlations.sparkSession)
    return correlations.withColumn("p", F.when((F.col("n") < 3) | (F.col("rho") == 0), 1.0).otherwise(spearman_p_udf()("rho", "n")))


def box_stats(long: DataFrame, group: list[str]) -> DataFrame:
    """Quartiles, and the last values within 1.5 interquartile ranges of them."""
    q = quantiles(long, group, "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    rows = long.join(q, group)
    return rows.groupBy(*group, "q1", "q2", "q3").agg(
        F.min(F.when(F.col("value") >= F.col("q1") - reach, F.col("value"))).alias("low"), F.max(F.when(F.col("value") <= F.col("q3") + reach, F.col("value"))).alias("high"), F.count("*").alias("n")
    )


def auroc(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve, from the U statistic; null if a class is missing."""
    return rank_sums(scored, keys, score, label).select(*keys, "n1", "n0", F.try_divide("u", (F.col("n1") * F.col("n0")).cast("double")).alias("auroc"))


def calibration_error(scored: DataFrame, keys: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, and Brier score."""
    y, p = F.col(label).cast("double"), F.col(score)
    bin_ = F.least(F.floor(p * bins), F.lit(bins - 1))
    cells = scored.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("acc"), F.sum((p - y) * (p - y)).alias("sq"))
    total = F.sum("n")
    return cells.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / total).alias("ece"), (F.sum("sq") / total).alias("brier"), total.alias("n"))


def detection_quality(found: DataFrame, truth: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Precision and recall of detected places against annotated ones."""
    both = found.select(*keys, F.lit(1).alias("f")).join(truth.select(*keys, F.lit(1).alias("t")), keys, "full")
    hit, n_found, n_true = F.count_if((F.col("f") == 1) & (F.col("t") == 1)), F.count("f"), F.count("t")
    return both.groupBy(*group).agg(hit.alias("hits"), n_found.alias("n_found"), n_true.alias("n_true"), F.try_divide(hit, n_found).alias("precision"), F.try_divide(hit, n_true).alias("recall"))


def kappa(pairs: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """Cohen's kappa of two annotators, from their contingency table."""
    cells = pairs.groupBy(*group, a, b).agg(F.count("*").alias("n"))
    agree = cells.groupBy(*group).agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*group, F.col(a).alias("c")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*group, F.col(b).alias("c")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*group, "c"]).groupBy(*group).agg(F.sum(F.col("na") * F.col("nb")).alias("by_chance"))
    po, pe = F.col("same") / F.col("total"), F.coalesce("by_chance", F.lit(0)) / (F.col("total") * F.col("total"))
    return agree.join(chance, group, "left").select(*group, po.alias("observed"), pe.alias("expected"), F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)).alias("kappa"))


def with_modes(traces: DataFrame, early: float = 0.33, quiet: float = 0.33) -> DataFrame:
    """Adds ``mode``, how a trace goes: early and silent, late and noisy, or oscillating.

    Early and silent: commits in the first third of places and has a density in the lower third of all; late and noisy:
    the last and the upper third; the others oscillate. Right and wrong traces alike have a mode.
    """
    rows = traces.withColumn("_all", F.lit(0))
    shares = {"normalized_commitment": {"c0": early, "c1": 1 - early}, "density": {"d0": quiet, "d1": 1 - quiet}}
    cuts = [quantiles(rows, ["_all"], c, q).drop("_all") for c, q in shares.items()]
    rows = rows.crossJoin(F.broadcast(cuts[0])).crossJoin(F.broadcast(cuts[1]))  # one row each
    c, d = F.col("normalized_commitment"), F.col("density")
    mode = F.when((c <= F.col("c0")) & (d <= F.col("d0")), "early_silent").when((c >= F.col("c1")) & (d >= F.col("d1")), "late_noisy").otherwise("oscillating")
    return rows.withColumn("mode", mode).drop("_all", "c0", "c1", "d0", "d1")


def failure_modes(traces: DataFrame, group: list[str] = (), early: float = 0.33, quiet: float = 0.33) -> DataFrame:
    """Traces and accuracy per mode, and per domain if ``group`` names it."""
    return with_modes(traces, early, quiet).groupBy(*group, "mode").agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"))


def effect_by_group(comparison: DataFrame, group: list[str]) -> DataFrame:
    """Groups (model x embedding) by their number of significant features, the first in order on ties, from ``with_p``."""
    best = comparison.groupBy(*group).agg(F.count_if("significant").alias("n_significant"), F.min("p").alias("least_p"), F.max(F.abs("cohens_d")).alias("largest_d"))
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_significant"), *group)))  # few groups
