"""Similarity and drift curves of traces (V1-V17). A curve is long: keys, idx, sim."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.config import PARAMS
from tracemill.session import ship_package


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pooled(tokens: DataFrame, keys: list[str], vec: str, mask: str | None = None) -> DataFrame:
    """V1: mean of the (masked-in) vectors of a key, scaled to length 1; a zero mean stays zero."""
    rows = tokens if mask is None else tokens.filter(F.col(mask))
    sums = rows.select(*keys, F.posexplode(vec).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    size = norm(F.col("mean"))
    return whole.select(*keys, F.when(size > 0, F.transform("mean", lambda x: x / size)).otherwise(F.col("mean")).alias("vec"))


def similarity_curve(steps: DataFrame, keys: list[str], pos: str = "pos", vec: str = "vec") -> DataFrame:
    """V2: cosine of each step with the next, 0 if a norm is 0; N - 1 rows. One shuffle by trace."""
    nxt = F.lead(vec).over(Window.partitionBy(*keys).orderBy(pos))
    pair = steps.withColumn("next_vec", nxt).filter("next_vec is not null")
    size = norm(F.col(vec)) * norm(F.col("next_vec"))
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) - 1
    return pair.select(*keys, idx.alias("idx"), F.when(size > 0, dot(F.col(vec), F.col("next_vec")) / size).otherwise(0.0).alias("sim"))


def drift_curve(steps: DataFrame, keys: list[str], pos: str = "pos", vec: str = "vec") -> DataFrame:
    """Cosine of each step with the last one (1e-9 added to the norms), last step left out.

    The last vector of each trace comes from an aggregate and a join, not from a window that copies it to every row.
    """
    last = steps.groupBy(*keys).agg(F.max(pos).alias("last_pos"), F.max_by(vec, pos).alias("last_vec"))
    rows = steps.join(last, keys).filter(F.col(pos) < F.col("last_pos"))
    return rows.select(*keys, F.col(pos).alias("idx"), (dot(F.col(vec), F.col("last_vec")) / (norm(F.col(vec)) * norm(F.col("last_vec")) + 1e-9)).alias("drift"))


def with_transitions(curve: DataFrame, keys: list[str], drop: float = PARAMS.drop) -> DataFrame:
    """V3: adds ``is_transition``: unlikely low (z below -1.5 on a curve that isn't flat), or ``drop`` below the mean
    of the two neighbours on each side. Curves of fewer than 3 points have none."""
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("idx")
    n, std = F.count("*").over(whole), F.stddev_pop("sim").over(whole)
    low = (std > PARAMS.flat_std) & (F.try_divide(F.col("sim") - F.avg("sim").over(whole), std) < PARAMS.z)
    near = [F.lag("sim", 2).over(order), F.lag("sim").over(order), F.lead("sim").over(order), F.lead("sim", 2).over(order)]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in near[1:]), F.coalesce(near[0], F.lit(0.0)))  # added in order: exact ties count
    others = F.try_divide(total, sum((x.isNotNull().cast("int") for x in near), F.lit(0)).cast("double"))
    return curve.withColumn("is_transition", (n >= 3) & (F.coalesce(low, F.lit(False)) | F.coalesce(others - F.col("sim") > drop, F.lit(False))))


def transition_contexts(curve: DataFrame, steps: DataFrame, keys: list[str], pos: str, text: str) -> DataFrame:
    """V4: for each transition the step before and the step after it."""
    after = F.lead(text).over(Window.partitionBy(*keys).orderBy(pos))
    pairs = steps.select(*keys, F.col(pos).alias("idx"), F.col(text).alias("before"), F.coalesce(after, F.lit("")).alias("after"))
    return curve.filter("is_transition").select(*keys, "idx", "sim").join(pairs, [*keys, "idx"])


def _held(keys: list[str], sustain: int | None) -> Column:
    """Least of the ``sustain`` values from here on (cut off at the end), or of all of them: a running minimum from the end."""
    if sustain is None:
        return F.min("sim").over(Window.partitionBy(*keys).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.min("sim").over(Window.partitionBy(*keys).orderBy("idx").rowsBetween(0, sustain - 1))


def commitment(curve: DataFrame, keys: list[str], tau: float = PARAMS.tau, sustain: int | None = PARAMS.sustain) -> DataFrame:
    """First place from which ``sustain`` values (cut off at the end) are at least ``tau``; -1 and 1.0 for never.

    ``sustain=None`` is the strict form (R4): to the end of the curve.
    """
    held = curve.withColumn("low", _held(keys, sustain))
    out = held.groupBy(*keys).agg(F.min(F.when(F.col("low") >= tau, F.col("idx"))).alias("c"), F.count("*").alias("n"))
    return out.select(*keys, F.coalesce("c", F.lit(-1)).cast("long").alias("commitment_point"), F.coalesce(F.col("c") / F.col("n"), F.lit(1.0)).alias("normalized_commitment"))


def commitment_sweep(curve: DataFrame, keys: list[str], taus: list[float]) -> DataFrame:
    """Strict commitment at several thresholds, all read off one running minimum."""
    held = curve.withColumn("low", _held(keys, None))
    first = F.array(*[F.struct(F.lit(t).alias("tau"), F.min(F.when(F.col("low") >= t, F.col("idx"))).alias("c")) for t in taus])
    out = held.groupBy(*keys).agg(first.alias("found"), F.count("*").alias("n")).select(*keys, "n", F.explode("found").alias("f")).select(*keys, "n", "f.*")
    return out.select(*keys, "tau", F.coalesce("c", F.lit(-1)).cast("long").alias("commitment_point"), F.coalesce(F.col("c") / F.col("n"), F.lit(1.0)).alias("normalized_commitment"))


def trace_features(curve: DataFrame, keys: list[str], drop: float = PARAMS.drop, tau: float = PARAMS.tau, sustain: int = PARAMS.sustain) -> DataFrame:
    """One row of features per curve of at least two points.

    All windows and the aggregate share the partitioning by trace: one shuffle. ``max_drop`` is negative on a curve
    that only rises.
    """
    order, whole = Window.partitionBy(*keys).orderBy("idx"), Window.partitionBy(*keys)
    rows = with_transitions(curve, keys, drop)
    rows = rows.withColumns({
        "n": F.count("*").over(whole), "next": F.lead("sim").over(order), "next2": F.lead("sim", 2).over(order),
        "held": _held(keys, sustain),
    })
    i, n, sim = F.col("idx"), F.col("n"), F.col("sim")
    half = F.floor(n / 2)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_steps"),
        F.count_if("is_transition").alias("n_transitions"),
        F.regr_slope(sim, i.cast("double")).alias("slope"),
        F.avg(sim).alias("mean_sim"), F.min(sim).alias("min_sim"), F.max(sim).alias("max_sim"), F.stddev_pop(sim).alias("std_sim"),
        F.max(F.when(i == half, sim)).alias("midpoint_sim"),
        F.coalesce(F.max(sim - F.col("next")), F.lit(0.0)).alias("max_drop"),
        F.avg(F.when(i >= n - 3, sim)).alias("final_convergence"),
        F.min(F.when(F.col("held") >= tau, i)).alias("c"),
        F.coalesce(F.min(F.when(sim >= PARAMS.depth_tau, i)) / F.max(n), F.lit(1.0)).alias("commitment_depth"),
        F.when(F.max(half) >= 2, F.var_pop(F.when(i < half, sim))).otherwise(0.0).alias("first_half_variance"),
        F.when(F.max(n) >= 4, F.avg(F.abs(F.col("next2") - 2 * F.col("next") + sim))).otherwise(0.0).alias("roughness"),
    )
    return out.withColumns({
        "trace_length": F.col("n_steps") + 1,
        "commitment_point": F.coalesce("c", F.lit(-1)).cast("long"),
        "normalized_commitment": F.coalesce(F.col("c") / F.col("n_steps"), F.lit(1.0)),
    }).drop("c")


def mean_drift(drift: DataFrame, keys: list[str]) -> DataFrame:
    """Mean drift of a trace to its last step."""
    return drift.groupBy(*keys).agg(F.avg("drift").alias("mean_drift_to_final"))


def vector_features(steps: DataFrame, keys: list[str], pos: str = "pos", vec: str = "vec", min_steps: int = PARAMS.min_sentences) -> DataFrame:
    """The whole feature row of a trace from its step vectors; traces of fewer than ``min_steps`` steps give none.

    Curve, drift and features are keyed by trace, so one shuffle of the vectors serves all three.
    """
    features = trace_features(similarity_curve(steps, keys, pos, vec), keys).filter(F.col("trace_length") >= min_steps)
    drift = mean_drift(drift_curve(steps, keys, pos, vec), keys)
    return features.join(drift, keys, "left").withColumn("mean_drift_to_final", F.coalesce("mean_drift_to_final", F.lit(0.0)))


def _running_variance(keys: list[str], pos: str, vec: str):
    """Rows sorted by trace and step, batch by batch, to the variance of the vectors so far; only the last trace's sums are carried on."""

    def run(batches):
        last, count, total, square = None, 0, None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
            lists = batch.column(batch.schema.get_field_index(vec))
            width = np.diff(lists.offsets.to_numpy())
            flat, at, out = lists.flatten().to_numpy(zero_copy_only=False).astype(float), 0, np.zeros(len(names))
            begin = 0
            while begin < len(names):
                end, n = begin + 1, int(width[begin])
                while end < len(names) and names[end] == names[begin]:
                    end += 1
                if (width[begin:end] != n).any():
                    raise ValueError("vectors of one trace differ in length")
                x = flat[at : at + n * (end - begin)].reshape(end - begin, n)
                at += x.size
                if names[begin] != last or total is None:
                    last, count, total, square = names[begin], 0, np.zeros(n), 0.0
                sums, squares = total + np.cumsum(x, axis=0), square + np.cumsum((x * x).sum(axis=1))
                seen = count + np.arange(1, end - begin + 1)
                out[begin:end] = squares / seen - ((sums / seen[:, None]) ** 2).sum(axis=1)
                count, total, square = int(seen[-1]), sums[-1], float(squares[-1])
                begin = end
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in [*keys, pos]), pa.array(out)], names=[*keys, pos, "variance"])

    return run


def accumulated_variance(steps: DataFrame, keys: list[str], pos: str = "pos", vec: str = "vec") -> DataFrame:
    """R2: variance of the first d step vectors around their mean, for each d: mean square norm minus squared norm of the mean.

    A running sum of vectors over the sorted rows of each trace, in Arrow batches: one row in, one row out, and of a trace only its sums
    are kept. Null vectors are left out; vectors of a trace must be of one length.
    """
    ship_package(steps.sparkSession)
    rows = steps.select(*keys, pos, vec).filter(F.col(vec).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, pos)
    shape = StructType([rows.schema[c] for c in [*keys, pos]]).add("variance", "double")
    return rows.mapInArrow(_running_variance(keys, pos, vec), shape)


#: Grid places that are summed in one window; a longer grid is cut to ranges, whose totals are summed first.
GRID_RANGE = 1 << 16


def mean_curve(curve: DataFrame, keys: list[str], group: list[str], grid_range: int = GRID_RANGE) -> DataFrame:
    """Curves of a group laid on a grid as long as the group's longest, averaged by place.

    Each curve stands between its own first and last point; grid points between two of its points are interpolated. On the grid a
    curve is a line from point to point: at each point its height and slope change, once. These changes are added up
    by place, and two running sums give the sum of all curves at every place, so the work is that of the curves' own
    lengths, whatever the longest is. (The longest curve has a point at every place.) Keys belong to one group each.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    rows = curve.select(*keys, *[g for g in group if g not in keys], "idx", "sim").withColumns({"n": F.count("*").over(Window.partitionBy(*keys)), "before": F.lag("sim").over(order), "next": F.lead("sim").over(order)})
    sizes = rows.filter("before is null").groupBy(*group).agg(F.max("n").alias("points"), F.count("*").alias("n_curves"))
    same = reduce(and_, [F.col(f"c.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group])
    rows = rows.alias("c").join(sizes.alias("s"), same).select(*[F.col(f"c.{g}").alias(g) for g in group], "idx", "sim", "n", "before", "next", "points")
    i, span, step = F.col("idx").cast("long"), F.col("n") - 1, F.col("points") - 1
    g = F.when(span == 0, F.lit(0)).otherwise(F.expr("(cast(idx as long) * (points - 1) + n - 2) div greatest(n - 1, 1)"))  # the first place not before the point
    ratio = F.try_divide(span.cast("double"), step.cast("double"))
    slope = lambda a, b: F.coalesce((b - a) * ratio, F.lit(0.0))
    after, ahead = slope(F.col("sim"), F.col("next")), slope(F.col("before"), F.col("sim"))
    # A line through the point i with slope s has height sim - s * i / ratio at place 0.
    base = lambda s: F.col("sim") - F.coalesce(F.try_divide(s * i, ratio), F.lit(0.0))
    first = F.col("before").isNull()
    height = F.when(first, base(after)).otherwise(base(after) - base(ahead))
    turns = rows.filter((F.col("next").isNotNull()) | first).select(*group, g.cast("long").alias("g"), height.alias("a"), F.when(first, after).otherwise(after - ahead).alias("s"))
    ends = rows.filter((F.col("next").isNull()) & ~first).select(*group, g.cast("long").alias("g"), F.lit(0.0).alias("a"), F.lit(0.0).alias("s"))  # the grid's last place
    places = turns.unionByName(ends).groupBy(*group, "g").agg(F.sum("a").alias("a"), F.sum("s").alias("s")).withColumn("range", F.floor(F.col("g") / grid_range))
    whole = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = places.groupBy(*group, "range").agg(F.sum("a").alias("a0"), F.sum("s").alias("s0")).withColumns({c: F.coalesce(F.sum(c).over(whole), F.lit(0.0)) for c in ("a0", "s0")})
    inside = Window.partitionBy(*group, "range").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*group, "range"]])
    summed = places.withColumns({"a": F.sum("a").over(inside), "s": F.sum("s").over(inside)}).alias("p").join(offsets.alias("o"), on).select(*[F.col(f"p.{c}").alias(c) for c in group], "g", (F.col("a") + F.col("a0") + (F.col("s") + F.col("s0")) * F.col("g")).alias("sum"))
    same = reduce(and_, [F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in group])
    return summed.alias("c").join(sizes.alias("s"), same).select(*[F.col(f"c.{x}").alias(x) for x in group], "g", (F.col("sum") / F.col("n_curves")).alias("mean_sim"), "n_curves")
