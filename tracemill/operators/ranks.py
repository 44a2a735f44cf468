"""Average ranks and exact quantiles in groups that hold all traces, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group's distinct values are cut to the square of so many ranges, and a window runs over one range of one group: with a
#: thousand ranges a group of 10^9 distinct values has about 10^6 in a window.
CUTS = 32


def _range_of(value: Column) -> Column:
    """Range of a value by the nested array ``cuts``: first among every ``CUTS``-th cut, then among those that follow it."""
    outer = F.size(F.filter("cuts", lambda c: c[0] < value)) - 1
    inner = lambda i: F.size(F.filter(F.get("cuts", i), lambda c: c < value))
    return F.when(outer < 0, F.lit(0)).otherwise(outer * CUTS + inner(outer))


def average_ranks(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (keys, value): ``n`` rows, ``upto`` (rows with a value not larger), ``total`` (rows of the group), ``rank``
    (average rank in the group), ``mid`` (a value in the middle of the group), and sums of ``measures``.

    Rows are first combined by value (map-side). Each group's values are cut to ranges at approximate quantiles; ranges
    give offsets, and ranks within a range come from a window over its distinct values only. Null values have no rank.

    Three branches read the combined values. Each refers to all their columns (``whole``, never null), as branches with other
    columns pruned would each compute the rows anew instead of sharing one shuffle.
    """
    rows = df.filter(F.col(value).isNotNull())
    values = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in measures.items()])
    parts = CUTS * CUTS
    flat = F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * parts)
    whole = F.max(F.struct("n", *measures)).alias("whole")
    cuts = values.groupBy(*keys).agg(flat.alias("flat"), whole).filter("whole is not null").select(*keys, F.transform(F.sequence(F.lit(0), F.lit(CUTS - 1)), lambda i: F.slice("flat", i * CUTS + 1, CUTS)).alias("cuts"))
    placed = values.join(cuts, keys).withColumns({"range": _range_of(F.col(value)), "mid": F.get(F.get("cuts", F.lit(CUTS // 2)), F.lit(0))}).drop("cuts")
    totals = placed.groupBy(*keys, "range").agg(F.sum("n").alias("range_n"), whole).filter("whole is not null").drop("whole")
    group = Window.partitionBy(*keys)  # over one row per range
    before = F.sum("range_n").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumns({"offset": F.coalesce(before, F.lit(0)), "total": F.sum("range_n").over(group)}).drop("range_n")
    inside = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(totals, [*keys, "range"]).withColumn("upto", F.col("offset") + F.sum("n").over(inside))
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    return ranked.select(*keys, value, "n", "upto", "total", "mid", *measures, rank.alias("rank"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, interpolated between neighbours: one column per name in ``shares``.

    A quantile lies at place (n - 1) * share; the values that cover the places on both sides of it come from the running
    counts of ``average_ranks``, so that no buffer holds a group.
    """
    ranks = average_ranks(df, keys, value, {})

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col(value).cast("double")))

    place = {k: (F.col("total") - 1) * F.lit(float(q)) for k, q in shares.items()}
    found = ranks.groupBy(*keys).agg(*[x for k, p in place.items() for x in (at(F.floor(p)).alias(f"{k}_lo"), at(F.ceil(p)).alias(f"{k}_hi"))], F.max("total").alias("total"))
    return found.select(*keys, *[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (p - F.floor(p))).alias(k) for k, p in place.items()])


def ties(n: Column) -> Column:
    """Sum of t^3 - t, in doubles: a value of some million rows is beyond a long."""
    t = n.cast("double")
    return F.sum(t * t * t - t)


def u_statistic() -> Column:
    """U of the labelled rows (sum of ``ones``) over rows of ``average_ranks``."""
    n1 = F.sum("ones").cast("double")
    return F.sum(F.col("rank") * F.col("ones")) - n1 * (n1 + 1) / 2


def rank_sums(df: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """Per group: n1, n0 (rows with and without ``label``), U of the labelled, and the tie sum of t^3 - t."""
    ranks = average_ranks(df, keys, value, {"ones": F.col(label).cast("int")})
    return ranks.groupBy(*keys).agg(F.sum("ones").alias("n1"), F.sum(F.col("n") - F.col("ones")).alias("n0"), u_statistic().alias("u"), ties(F.col("n")).alias("ties"))


def spearman(df: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """Rank correlation of a value with a 0/1 label per group; 0 if either is constant or there are under 3 rows.

    Ranks of the label follow from its counts; the correlation is that of the ranks, from sums over distinct values.
    Also the value's means for label 0 and 1 (``mean_0``, ``mean_1``), null without such rows.
    """
    ranks = average_ranks(df, keys, value, {"ones": F.col(label).cast("int")})
    s = ranks.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("ones").alias("n1"), F.sum(F.col("rank") * F.col("ones")).alias("r1"),
        F.sum(F.col("rank") * F.col("rank") * F.col("n")).alias("rr"),
        F.sum(F.col(value) * F.col("ones")).alias("sum1"), F.sum(F.col(value) * (F.col("n") - F.col("ones"))).alias("sum0"),
    )
    n, n1 = F.col("n"), F.col("n1")
    mean = (n + 1) / 2
    cov = F.col("r1") / n - mean * n1 / n  # of the rank with the label
    var = F.col("rr") / n - mean * mean
    p = n1 / n
    rho = F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)) * p * (1 - p)))
    means = F.try_divide("sum0", (n - n1).cast("double")).alias("mean_0"), F.try_divide("sum1", n1.cast("double")).alias("mean_1")
    return s.select(*keys, "n", F.when(n >= 3, F.coalesce(rho, F.lit(0.0))).otherwise(0.0).alias("rho"), *means)
