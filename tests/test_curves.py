import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import coupling, curves, states

CURVES = {
    "flat": [0.5] * 6, "two": [0.2, 0.9], "one": [0.9], "three": [0.9, 0.1, 0.9], "rise": [0.1, 0.2, 0.4, 0.7, 0.9], "last": [0.1, 0.2, 0.3, 0.85], "zig": [0.8, 0.79, 0.8, 0.81, 0.2, 0.9, 0.95],
}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    made = CURVES | {f"r{i}": [round(rng.random(), 3) for _ in range(rng.randrange(3, 40))] for i in range(20)}
    rows = [(k, i, s) for k, c in made.items() for i, s in enumerate(c)]
    return made, spark.createDataFrame(rows, "q string, idx long, sim double").repartition(5)


def plain_transitions(c):
    c, out = np.array(c), []
    for i in range(len(c)) if len(c) >= 3 else ():
        near = np.delete(c[max(0, i - 2) : i + 3], min(i, 2))
        if (c.std() > 0.01 and (c[i] - c.mean()) / c.std() < -1.5) or near.mean() - c[i] > 0.15:
            out.append(i)
    return out


def plain_commitment(c, tau=0.8, sustain=2):
    return next((i for i in range(len(c)) if min(c[i : i + sustain]) >= tau), -1)


def test_transitions(table):
    made, df = table
    got = {k: [] for k in made}
    for r in curves.with_transitions(df, ["q"]).filter("is_transition").collect():
        got[r.q].append(r.idx)
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_transitions(c) for k, c in made.items()}


def test_features(table):
    made, df = table
    for r in curves.trace_features(df, ["q"]).collect():
        c, n = np.array(made[r.q]), len(made[r.q])
        point = plain_commitment(c)
        want = {
            "n_steps": n, "trace_length": n + 1, "n_transitions": len(plain_transitions(c)), "mean_sim": c.mean(), "min_sim": c.min(), "max_sim": c.max(), "std_sim": c.std(), "midpoint_sim": c[n // 2],
            "max_drop": max(-np.diff(c)) if n > 1 else 0.0, "final_convergence": c[-3:].mean(), "commitment_point": point, "normalized_commitment": point / n if point >= 0 else 1.0,
            "commitment_depth": next((i / n for i in range(n) if c[i] >= 0.7), 1.0), "first_half_variance": c[: n // 2].var() if n // 2 >= 2 else 0.0, "roughness": np.abs(np.diff(c, 2)).mean() if n >= 4 else 0.0,
        }
        if n > 1:
            want["slope"] = np.polyfit(np.arange(n), c, 1)[0]
        for k, v in want.items():
            assert r[k] == pytest.approx(v, abs=1e-9), (r.q, k)
    rise = curves.trace_features(df.filter("q = 'rise'"), ["q"]).first()
    assert rise.max_drop == pytest.approx(-0.1)
    assert curves.trace_features(df.filter("q = 'last'"), ["q"]).first().commitment_point == 3  # the last point alone counts


def test_commitment_forms(table):
    made, df = table
    for sustain in (1, 2, 3):
        got = {r.q: r.commitment_point for r in curves.commitment(df, ["q"], 0.8, sustain).collect()}
        assert got == {k: plain_commitment(c, 0.8, sustain) for k, c in made.items()}
    strict = {r.q: r.commitment_point for r in curves.commitment(df, ["q"], 0.6, None).collect()}
    assert strict == {k: plain_commitment(c, 0.6, 10**6) for k, c in made.items()}
    sweep = {r.q: r.commitment_point for r in curves.commitment_sweep(df, ["q"], [0.3, 0.6]).filter("tau = 0.6").collect()}
    assert sweep == strict


def test_mean_curve(table):
    made, df = table
    grouped = df.withColumn("g", F.when(F.col("q").startswith("r"), "r").otherwise("x")).withColumnRenamed("g", "grp")
    got = {(r.grp, r.g): r.mean_sim for r in curves.mean_curve(grouped, ["q"], ["grp"]).collect()}
    for grp in ("r", "x"):
        cs = [c for k, c in made.items() if (grp == "r") == k.startswith("r")]
        n = max(map(len, cs))
        want = np.mean([np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(c)), c) for c in cs], axis=0)
        assert [got[grp, i] for i in range(n)] == pytest.approx(list(want), abs=1e-9)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    made = {t: rng.normal(size=(n, 5)) for t, n in (("a", 7), ("b", 2), ("c", 1))}
    made["z"] = np.array([[0.0] * 5, [1.0] * 5])
    df = spark.createDataFrame([(t, i, [float(x) for x in v]) for t, m in made.items() for i, v in enumerate(m)], "t string, pos long, vec array<double>")
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    sims = {(r.t, r.idx): r.sim for r in curves.similarity_curve(df, ["t"]).collect()}
    drift = {(r.t, r.idx): r.drift for r in curves.drift_curve(df, ["t"]).collect()}
    var = {(r.t, r.pos): r.variance for r in curves.accumulated_variance(df, ["t"]).collect()}
    pooled = {r.t: r.vec for r in curves.pooled(df, ["t"], "vec").collect()}
    for t, m in made.items():
        for i in range(len(m) - 1):
            assert sims[t, i] == pytest.approx(float(unit(m[i]) @ unit(m[i + 1])))
            assert drift[t, i] == pytest.approx(float(unit(m[i]) @ unit(m[-1])), abs=1e-6)
        assert all(var[t, i] == pytest.approx(m[: i + 1].var(axis=0).sum(), abs=1e-9) for i in range(len(m)))
        assert pooled[t] == pytest.approx(list(unit(m.mean(axis=0))))
    assert len(sims) == len(drift) == 8


def test_states(spark):
    order = ["exploring", "committing", "verifying", "backtracking", "neutral"]
    rng = random.Random(5)
    made = {i: [rng.choice(order) for _ in range(rng.randrange(1, 30))] for i in range(25)} | {99: ["neutral"] * 4, 98: ["exploring"] * 15 + ["committing"] + ["neutral"] * 6}
    df = spark.createDataFrame([(q, i, s) for q, ss in made.items() for i, s in enumerate(ss)], "q int, pos long, state string")
    for r in states.trajectories(df, ["q"]).collect():
        s, n = made[r.q], len(made[r.q])
        first = s.index("committing") / n if "committing" in s else 1.0
        cut = int(first * n)
        assert r.final_state == next((x for x in reversed(s) if x != "neutral"), "neutral")
        assert r.first_commit_position == first and all(r[f"{x}_ratio"] == pytest.approx(s.count(x) / n) for x in order)
        assert r.explore_before_commit == pytest.approx(s[:cut].count("exploring") / max(1, cut))
    assert int(15 / 22 * 22) == 14 and states.trajectories(df.filter("q = 98"), ["q"]).first().explore_before_commit == pytest.approx(1.0)
    rows = states.transition_matrix(df, ["q"]).groupBy("q", "state").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()
    assert all(r.n == 5 and (r.p == 0 or r.p == pytest.approx(1)) for r in rows)


def test_coupling(spark):
    markers = spark.createDataFrame([(1, 0, "revise"), (1, 3, "revise"), (1, 3, "hedge"), (1, 9, "hedge"), (2, 1, "hedge"), (3, 0, "hedge")], "q int, pos long, category string")
    transitions = spark.createDataFrame([(1, 3), (1, 7), (3, 2)], "q int, pos long")
    sizes = spark.createDataFrame([(1, 10), (2, 10), (3, 4)], "q int, n_sentences long")
    events = coupling.coupling_events(markers, transitions, sizes, ["q"])
    assert sorted((r.q, r.category, r.distance, r.marker_position) for r in events.collect()) == [(1, "hedge", 4, 0.3), (1, "revise", 3, 0.0), (1, "revise", 4, 0.3)]
    s = {r.category: r for r in coupling.coupling_summary(events.withColumn("m", F.lit("m")), ["m"]).collect()}
    assert s["revise"].within_near == 1 and s["revise"].pct_within_near == 50.0 and s["hedge"].mean_distance == 4.0
    lift = coupling.lift_over_chance(coupling.coupling_summary(events.withColumn("m", F.lit("m")), ["m"]), sizes.withColumn("m", F.lit("m")), ["m"]).first()
    assert lift.chance_pct == pytest.approx(37.5) and lift.lift == pytest.approx(50 / 37.5) and not lift.strong


def test_mean_curve_longer_than_1000(spark):
    """The grid is as long as the longest curve, however long that is."""
    n = 1500
    rows = [("m", "a", i, float(i % 7)) for i in range(n)] + [("m", "b", i, 2.0 * i) for i in range(2)]
    got = {r.g: (r.mean_sim, r.n_curves) for r in curves.mean_curve(spark.createDataFrame(rows, "g0 string, k string, idx long, sim double"), ["k"], ["g0"]).collect()}
    assert len(got) == n
    assert all(got[i][1] == 2 and abs(got[i][0] - (i % 7 + 2.0 * i / (n - 1)) / 2) < 1e-9 for i in range(n))


def _laid(curves, points):
    """A curve's values on a grid, place by place."""
    n = len(curves)
    if n == 1 or points == 1:
        return [curves[0]] * points
    out = []
    for g in range(points):
        i, rest = divmod(g * (n - 1), points - 1)
        out.append(curves[i] + (curves[i + 1] - curves[i]) * rest / (points - 1) if rest else curves[i])
    return out


def test_mean_curve_against_every_place(spark):
    """Groups of one point, of curves of like and unlike lengths, and a null group, with ranges of a few places."""
    import random

    rng = random.Random(8)
    made = {("a", f"a{k}"): [rng.uniform(-1, 1) for _ in range(n)] for k, n in enumerate([1, 2, 3, 7, 50, 211, 211])}
    made |= {("b", f"b{k}"): [rng.uniform(-1, 1)] for k in range(3)} | {(None, "n"): [0.5, 0.25], (None, "m"): [1.0, 2.0, 4.0]}
    rows = [(g, k, i, x) for (g, k), c in made.items() for i, x in enumerate(c)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g0 string, k string, idx int, sim double")
    for size in (1 << 16, 5):
        got = {(r.g0, r.g): (r.mean_sim, r.n_curves) for r in curves.mean_curve(frame, ["k"], ["g0"], size).collect()}
        want = {}
        for group in ("a", "b", None):
            mine = [c for (g, _), c in made.items() if g == group]
            laid = [_laid(c, max(map(len, mine))) for c in mine]
            want |= {(group, i): (sum(x) / len(x), len(x)) for i, x in enumerate(zip(*laid))}
        assert set(got) == set(want)
        assert all(abs(got[k][0] - v) < 1e-9 and got[k][1] == n for k, (v, n) in want.items())


def test_mean_curve_makes_no_grid_for_each_curve(spark):
    """2,000 short curves and one of 20,000 points: rows are those of the curves, where a grid for each would have 40 million."""
    short = spark.range(6000).selectExpr("'g' as g0", "concat('k', id div 3) as k", "id % 3 as idx", "cast(id % 7 as double) as sim")
    long = spark.range(20_000).selectExpr("'g' as g0", "'long' as k", "id as idx", "cast(id % 5 as double) as sim")
    df = curves.mean_curve(short.unionByName(long), ["k"], ["g0"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    rows = df.collect()
    assert len(rows) == 20_000 and {r.n_curves for r in rows} == {2001}


def test_running_variance_over_batches(spark):
    """A trace over many Arrow batches, and traces next to each other, against sums over all vectors so far."""
    import random

    import numpy as np

    rng = random.Random(5)
    made = {k: [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(n)] for k, n in {"a": 1, "b": 5, "c": 300, None: 4}.items()}
    rows = [(k, i, v) for k, vs in made.items() for i, v in enumerate(vs)] + [("d", 0, None)]
    rng.shuffle(rows)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = curves.accumulated_variance(spark.createDataFrame(rows, "t string, pos int, vec array<double>"), ["t"])
        got = {(r.t, r.pos): r.variance for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert "posexplode" not in df._jdf.queryExecution().toString() and len(got) == 310
    for k, vs in made.items():
        x = np.array(vs)
        for i in range(len(vs)):
            assert abs(got[k, i] - x[: i + 1].var(axis=0).sum()) < 1e-9
