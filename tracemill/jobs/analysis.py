"""Registered jobs on curves, states, coupling, questions and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.jobs import tables as T
from tracemill.operators import clusters, consensus, coupling, curves, states
from tracemill.operators import comparison as G
from tracemill.operators.ranks import quantiles, spearman
from tracemill.stages import Stages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["model_name", "user_id", "is_correct"]
FEATURES = ["n_transitions", "slope", "mean_sim", "min_sim", "std_sim", "trace_length", "midpoint_sim", "max_drop", "final_convergence", "commitment_point", "normalized_commitment", "roughness"]


def job(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits and integers as longs, as the SQL has them."""
    cast = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "int": lambda c: c.cast("long")}
    return df.select(*[cast[t](F.col(c)).alias(c) if t in cast else F.col(c) for c, t in df.dtypes])


def r(x: str, name: str = "") -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


FEATURE_SQL = (
    "WITH "
    + T.TRANSITIONS
    + """, more AS (
  SELECT *, lead(sim) OVER o AS s1, lead(sim, 2) OVER o AS s2,
         min(sim) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS held
  FROM curve WINDOW o AS (PARTITION BY user_id ORDER BY pos)
), features AS (
  SELECT model_name, user_id, is_correct, count(*) AS n_steps, count(*) FILTER (is_transition) AS n_transitions,
         regr_slope(sim, idx) AS slope, avg(sim) AS mean_sim, min(sim) AS min_sim, max(sim) AS max_sim, stddev_pop(sim) AS std_sim,
         max(sim) FILTER (idx = n // 2) AS midpoint_sim, coalesce(max(sim - s1), 0.0) AS max_drop, avg(sim) FILTER (idx >= n - 3) AS final_convergence,
         coalesce(min(idx) FILTER (sim >= 0.7) / max(n), 1.0) AS commitment_depth,
         CASE WHEN max(n) // 2 >= 2 THEN var_pop(sim) FILTER (idx < n // 2) ELSE 0.0 END AS first_half_variance,
         CASE WHEN max(n) >= 4 THEN avg(abs(s2 - 2 * s1 + sim)) ELSE 0.0 END AS roughness,
         count(*) + 1 AS trace_length, coalesce(min(idx) FILTER (held >= 0.8), -1) AS commitment_point,
         coalesce(min(idx) FILTER (held >= 0.8) / count(*), 1.0) AS normalized_commitment
  FROM more GROUP BY ALL)"""
)
FEATURE_NAMES = "slope mean_sim min_sim max_sim std_sim midpoint_sim max_drop final_convergence commitment_depth first_half_variance roughness normalized_commitment".split()
LONG_SQL = FEATURE_SQL + ", long AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT model_name, is_correct, '{f}' AS feature, {f}::DOUBLE AS value FROM features" for f in FEATURES) + ") WHERE value IS NOT NULL AND value <> -1)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.trace_features(T.curve(spark, sf_dir), KEYS)


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.long_features(features(spark, sf_dir), ["model_name"], FEATURES)


@job(FEATURE_SQL + f" SELECT model_name, user_id, is_correct, n_steps, n_transitions, trace_length, commitment_point, {', '.join(map(r, FEATURE_NAMES))} FROM features")
def trace_features(spark, sf_dir):
    """V3, V5-V11, V13-V16."""
    return rounded(features(spark, sf_dir))


@job("WITH " + T.TRANSITIONS + f" SELECT user_id, idx, {r('sim')}, event_type AS before, coalesce(after, '') AS after FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS after FROM curve) WHERE is_transition")
def transition_contexts(spark, sf_dir):
    """V3, V4."""
    s = T.steps(spark, sf_dir)
    found = curves.with_transitions(s.select("user_id", F.col("pos").alias("idx"), "sim"), ["user_id"])
    return rounded(curves.transition_contexts(found, s, ["user_id"], "pos", "event_type"))


@job("WITH " + T.VECTORS + """, pairs AS (SELECT trace_id, pos, vec, lead(vec) OVER (PARTITION BY trace_id ORDER BY pos) AS nxt FROM vectors)
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS idx, round(list_dot_product(vec, nxt) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(nxt, nxt))), 6) + 0.0 AS sim
FROM pairs WHERE nxt IS NOT NULL""")  # fmt: skip
def similarity_curve(spark, sf_dir):
    """V2."""
    return rounded(curves.similarity_curve(T.vectors(spark, sf_dir), ["trace_id"]))


@job("WITH " + T.VECTORS + """, ends AS (SELECT trace_id, max(pos) AS last_pos, arg_max(vec, pos) AS last FROM vectors GROUP BY trace_id)
SELECT trace_id, pos AS idx, round(list_dot_product(vec, last) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(last, last)) + 1e-9), 6) + 0.0 AS drift
FROM vectors JOIN ends USING (trace_id) WHERE pos < last_pos""")  # fmt: skip
def drift_curve(spark, sf_dir):
    """V12."""
    return rounded(curves.drift_curve(T.vectors(spark, sf_dir), ["trace_id"]))


@job("WITH " + T.VECTORS + """, cells AS (SELECT trace_id, label, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS x FROM vectors),
means AS (SELECT trace_id, label, dim, avg(x) AS x FROM cells GROUP BY ALL)
SELECT trace_id, label::BIGINT AS label, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY trace_id, label)), 6) + 0.0 AS x FROM means""")  # fmt: skip
def pooled_vectors(spark, sf_dir):
    """V1: the vectors of a trace and label pooled, in long form."""
    out = curves.pooled(T.vectors(spark, sf_dir), ["trace_id", "label"], "vec")
    return rounded(out.select("trace_id", "label", F.posexplode("vec").alias("dim", "x")))


@job("WITH " + T.VECTORS + """, cells AS (SELECT trace_id, pos, generate_subscripts(vec, 1) AS dim, unnest(vec) AS x FROM vectors),
v AS (SELECT trace_id, pos, avg(x * x) OVER w - avg(x) OVER w * avg(x) OVER w AS v FROM cells WINDOW w AS (PARTITION BY trace_id, dim ORDER BY pos))
SELECT trace_id, pos, round(sum(v), 6) + 0.0 AS variance FROM v GROUP BY ALL""")  # fmt: skip
def accumulated_variance(spark, sf_dir):
    """R2."""
    return rounded(curves.accumulated_variance(T.vectors(spark, sf_dir), ["trace_id"]))


@job(FEATURE_SQL + f""" SELECT model_name, count(*) AS n_traces, {r('100.0 * count(*) FILTER (n_transitions > 0) / count(*)', 'pct_with_transitions')}, {r('avg(n_transitions)', 'mean_transitions')},
{r('median(n_transitions)', 'median_transitions')}, {r('avg(trace_length)', 'mean_sentences')}, {r('avg(mean_sim)', 'mean_similarity')} FROM features GROUP BY model_name""")  # fmt: skip
def transition_summary(spark, sf_dir):
    """G1."""
    f = features(spark, sf_dir)
    middle = quantiles(f, ["model_name"], "n_transitions", {"median_transitions": 0.5})
    return rounded(f.groupBy("model_name").agg(
        F.count("*").alias("n_traces"), (100.0 * F.count_if(F.col("n_transitions") > 0) / F.count("*")).alias("pct_with_transitions"), F.avg("n_transitions").alias("mean_transitions"),
        F.avg("trace_length").alias("mean_sentences"), F.avg("mean_sim").alias("mean_similarity"),
    ).join(middle, "model_name"))


COMPARE_SQL = """, ranked AS (
  SELECT *, rank() OVER (PARTITION BY model_name, feature ORDER BY value) + (count(*) OVER (PARTITION BY model_name, feature, value) - 1) / 2.0 AS rk,
         count(*) OVER (PARTITION BY model_name, feature, value) AS t FROM long
), compared AS (
  SELECT model_name, feature, count(*) FILTER (is_correct) AS n_correct, count(*) FILTER (NOT is_correct) AS n_incorrect,
         avg(value) FILTER (is_correct) AS correct_mean, stddev_pop(value) FILTER (is_correct) AS correct_std,
         avg(value) FILTER (NOT is_correct) AS incorrect_mean, stddev_pop(value) FILTER (NOT is_correct) AS incorrect_std,
         var_samp(value) FILTER (is_correct) AS v1, var_samp(value) FILTER (NOT is_correct) AS v0,
         sum(rk) FILTER (is_correct) - count(*) FILTER (is_correct) * (count(*) FILTER (is_correct) + 1) / 2.0 AS u, sum(t::DOUBLE * t - 1) AS ties
  FROM ranked GROUP BY ALL
), effect AS (
  SELECT *, CASE WHEN n_correct < 2 OR n_incorrect < 2 THEN 0.0 ELSE coalesce((correct_mean - incorrect_mean) / nullif(sqrt(((n_correct - 1) * v1 + (n_incorrect - 1) * v0) / (n_correct + n_incorrect - 2)), 0), 0.0) END AS cohens_d FROM compared)"""


def erfc_sql(x: str) -> str:
    """Complementary error function of a column, from a series of positive terms; 1 at and below 0, exact to 1e-12 where it matters."""
    term = f"exp((2 * k + 1) * ln(greatest({x}, 1e-300)) + k * ln(2.0) - lgamma(2 * k + 3) + (k + 1) * ln(2.0) + lgamma(k + 2))"
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 6 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(generate_series(0, 200), lambda k: {term}))) END"


def t_tail_sql(rho: str, n: str) -> str:
    """Two-sided tail of Student's t of a rank correlation with n - 2 degrees of freedom, from the series of the incomplete beta function."""
    a, y = f"(({n} - 2) / 2.0)", f"least({rho} * {rho}, 1 - 1e-15)"
    term = f"exp(lgamma({a} + 0.5 + k) - lgamma({a} + 0.5) + lgamma(1.5) - lgamma(1.5 + k) + k * ln(greatest({y}, 1e-300)))"
    return f"1 - exp(0.5 * ln(greatest({y}, 1e-300)) + {a} * ln(1 - {y}) + lgamma({a} + 0.5) - lgamma({a}) - lgamma(0.5)) * 2 * list_sum(list_transform(generate_series(0, 600), lambda k: {term}))"


#: P from U in ``effect``: all orders of two small groups without ties are counted one by one, else the corrected normal tail.
P_SQL = f""", need AS (SELECT DISTINCT n_correct AS n1, n_incorrect AS n2 FROM effect WHERE ties = 0 AND least(n_correct, n_incorrect) BETWEEN 2 AND 8 AND n_correct + n_incorrect <= 22),
paths AS (SELECT n1, n2, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS v FROM need UNION ALL SELECT n1, n2, a + s, b + 1 - s, v + s * b FROM paths, (VALUES (0), (1)) way(s) WHERE CASE s WHEN 1 THEN a < n1 ELSE b < n2 END),
orders_of AS (SELECT n1, n2, v, count(*) AS ways FROM paths WHERE a = n1 AND b = n2 GROUP BY ALL),
counted AS (SELECT model_name, feature, least(1.0, 2.0 * sum(ways) FILTER (v >= greatest(u, n1 * n2 - u) - 1e-9) / sum(ways)) AS exact FROM effect JOIN orders_of ON n1 = n_correct AND n2 = n_incorrect WHERE ties = 0 GROUP BY ALL),
spread AS (SELECT *, n_correct::DOUBLE * n_incorrect / 12 * (n_correct + n_incorrect + 1 - ties / nullif((n_correct + n_incorrect)::DOUBLE * (n_correct + n_incorrect - 1), 0)) AS var FROM effect),
tail AS (SELECT *, (greatest(u, n_correct * n_incorrect - u) - n_correct * n_incorrect / 2.0 - 0.5) / sqrt(2 * nullif(var, 0)) AS x FROM spread),
tested AS (SELECT t.*, CASE WHEN least(n_correct, n_incorrect) < 2 THEN 1.0 WHEN least(n_correct, n_incorrect) <= 8 AND ties = 0 THEN c.exact WHEN var <= 0 THEN 1.0 ELSE least(1.0, e.p) END AS p
  FROM tail t LEFT JOIN counted c ON c.model_name = t.model_name AND c.feature = t.feature LEFT JOIN (SELECT model_name, feature, {erfc_sql('x')} AS p FROM tail) e ON e.model_name = t.model_name AND e.feature = t.feature)"""  # fmt: skip


def tested(sql: str) -> str:
    """SQL with p-values: its CTEs are recursive."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@job(LONG_SQL + COMPARE_SQL + f" SELECT model_name, feature, n_correct, n_incorrect, {', '.join(map(r, ['correct_mean', 'correct_std', 'incorrect_mean', 'incorrect_std', 'cohens_d', 'u', 'ties']))} FROM effect")
def feature_comparison(spark, sf_dir):
    """G2, G4 and the statistic of G3 (E8, G14 are of the same form)."""
    return rounded(G.group_comparison(long_features(spark, sf_dir), ["model_name"]))


_SIGNIFICANT = "least(n_correct, n_incorrect) >= 2 AND p < 0.05"
_NOTE = "CASE WHEN least(n_correct, n_incorrect) < 2 THEN 'insufficient_data' END"
TESTED_SQL = tested(LONG_SQL + COMPARE_SQL + P_SQL)


@job(TESTED_SQL + f" SELECT model_name, feature, n_correct, n_incorrect, {', '.join(map(r, ['correct_mean', 'correct_std', 'incorrect_mean', 'incorrect_std', 'cohens_d', 'u', 'ties', 'p']))}, {_SIGNIFICANT} AS significant, {_NOTE} AS note FROM tested")
def feature_tests(spark, sf_dir):
    """With p-values."""
    return rounded(G.with_p(G.group_comparison(long_features(spark, sf_dir), ["model_name"])))


@job(LONG_SQL + COMPARE_SQL + ", ".join([" SELECT feature"] + [f"round(max(cohens_d) FILTER (model_name = '{m}'), 6) + 0.0 AS {m}" for m in ("m0", "m1", "m2")]) + " FROM effect GROUP BY feature")
def effect_table(spark, sf_dir):
    """Features by models."""
    c = G.group_comparison(long_features(spark, sf_dir), ["model_name"])
    return rounded(c.groupBy("feature").pivot("model_name", ["m0", "m1", "m2"]).agg(F.max("cohens_d")))


@job(FEATURE_SQL + f""" SELECT model_name, {', '.join(r(f'avg({c}) FILTER ({"" if k == "correct" else "NOT "}is_correct)', f'{k}_{c}') for k in ('correct', 'incorrect') for c in ('commitment_depth', 'first_half_variance', 'roughness'))} FROM features GROUP BY model_name""")
def commitment_dynamics(spark, sf_dir):
    """G14, V13-V15."""
    right = {"correct": F.col("is_correct"), "incorrect": ~F.col("is_correct")}
    return rounded(features(spark, sf_dir).groupBy("model_name").agg(*[F.avg(F.when(w, F.col(c))).alias(f"{k}_{c}") for k, w in right.items() for c in ("commitment_depth", "first_half_variance", "roughness")]))


@job(LONG_SQL + f""", q AS (SELECT model_name, is_correct, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL)
SELECT model_name, is_correct, feature, {r('q1')}, {r('q2')}, {r('q3')}, {r('min(value) FILTER (value >= q1 - 1.5 * (q3 - q1))', 'low')}, {r('max(value) FILTER (value <= q3 + 1.5 * (q3 - q1))', 'high')}, count(*) AS n
FROM long JOIN q USING (model_name, is_correct, feature) WHERE feature IN ('n_transitions', 'mean_sim', 'normalized_commitment') GROUP BY ALL, q1, q2, q3""".replace("GROUP BY ALL, q1, q2, q3", "GROUP BY model_name, is_correct, feature, q1, q2, q3"))  # fmt: skip
def box_plot(spark, sf_dir):
    """G15."""
    long = G.long_features(features(spark, sf_dir), ["model_name"], ["n_transitions", "mean_sim", "normalized_commitment"])
    return rounded(G.box_stats(long, ["model_name", "is_correct", "feature"]))


@job("WITH " + T.STEPS + """, sized AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM steps), longest AS (SELECT model_name, is_correct, max(n) AS points FROM sized GROUP BY ALL),
grid AS (SELECT model_name, is_correct, points, unnest(generate_series(0, points - 1)) AS g FROM longest),
traces AS (SELECT DISTINCT model_name, is_correct, user_id, n FROM sized),
placed AS (SELECT t.*, g, points, g * (n - 1) / (points - 1) AS x FROM traces t JOIN grid USING (model_name, is_correct)),
laid AS (SELECT a.model_name, a.is_correct, a.g, s.sim + coalesce((s2.sim - s.sim) * (a.x - s.pos), 0) AS v FROM placed a JOIN steps s ON s.user_id = a.user_id AND s.pos = floor(a.g * (a.n - 1) // (a.points - 1)) LEFT JOIN steps s2 ON s2.user_id = a.user_id AND s2.pos = s.pos + 1)
SELECT model_name, is_correct, g, round(avg(v) + 1e-9, 6) + 0.0 AS mean_sim, count(*) AS n_curves FROM laid GROUP BY ALL""")  # fmt: skip
def mean_curves(spark, sf_dir):
    """V17."""
    means = curves.mean_curve(T.curve(spark, sf_dir), ["user_id"], ["model_name", "is_correct"])
    return rounded(means.withColumn("mean_sim", F.col("mean_sim") + 1e-9))  # off the ties of rounding


TAUS = [0.1, 0.2, 0.3]


@job("WITH " + T.STEPS + """, grid AS (SELECT *, unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS tau FROM steps), held AS (SELECT *, min(sim) OVER (PARTITION BY user_id, tau ORDER BY pos DESC) AS low FROM grid)
SELECT user_id, tau, coalesce(min(pos) FILTER (low >= tau), -1) AS commitment_point, round(coalesce(min(pos) FILTER (low >= tau) / count(*), 1.0), 6) + 0.0 AS normalized_commitment FROM held GROUP BY ALL""")  # fmt: skip
def commitment_sweep(spark, sf_dir):
    """R4."""
    return rounded(curves.commitment_sweep(T.curve(spark, sf_dir), ["user_id"], TAUS))


STATE_SHARES = ["exploring", "committing", "verifying", "backtracking", "neutral"]
TRAJ_SQL = "WITH " + T.STEPS + f""", f AS (SELECT *, count(*) OVER w AS n, min(pos) FILTER (state = 'committing') OVER w AS first FROM steps WINDOW w AS (PARTITION BY user_id)),
c AS (SELECT *, coalesce(first / n, 1.0) AS fc, trunc(coalesce(first / n, 1.0) * n)::BIGINT AS cut FROM f),
traj AS (SELECT model_name, user_id, is_correct, count(*) AS n_sentences, {', '.join(f"avg((state = '{s}')::INT) AS {s}_ratio" for s in STATE_SHARES)},
coalesce(arg_max(state, pos) FILTER (state <> 'neutral'), 'neutral') AS final_state, max(fc) AS first_commit_position,
count(*) FILTER (state = 'exploring' AND pos < cut) / greatest(max(cut), 1) AS explore_before_commit FROM c GROUP BY ALL)"""  # fmt: skip
RATIOS = [f"{s}_ratio" for s in STATE_SHARES] + ["first_commit_position", "explore_before_commit"]


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.trajectories(T.steps(spark, sf_dir).select(*KEYS, "pos", "state"), KEYS)


@job(TRAJ_SQL + f" SELECT model_name, user_id, is_correct, n_sentences, final_state, {', '.join(map(r, RATIOS))} FROM traj")
def state_trajectories(spark, sf_dir):
    """E1, E3-E6."""
    return rounded(trajectories(spark, sf_dir))


@job("WITH " + T.STEPS + """, p AS (SELECT user_id, state, lead(state) OVER (PARTITION BY user_id ORDER BY pos) AS next FROM steps), k AS (SELECT user_id, state, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY ALL),
s AS (SELECT unnest(['exploring', 'committing', 'verifying', 'backtracking', 'neutral']) AS state), g AS (SELECT user_id, a.state, b.state AS next FROM (SELECT DISTINCT user_id FROM k), s a, s b)
SELECT g.user_id, g.state, g.next, round(coalesce(k.n / sum(k.n) OVER (PARTITION BY g.user_id, g.state), 0.0), 6) + 0.0 AS p FROM g LEFT JOIN k ON g.user_id = k.user_id AND g.state = k.state AND g.next = k.next""")  # fmt: skip
def state_transition_matrix(spark, sf_dir):
    """E2."""
    return rounded(states.transition_matrix(T.steps(spark, sf_dir).select("user_id", "pos", "state"), ["user_id"]))


@job(TRAJ_SQL + " SELECT model_name, is_correct, final_state, count(*) AS n FROM traj GROUP BY ALL")
def final_states(spark, sf_dir):
    """E7."""
    return states.final_state_counts(trajectories(spark, sf_dir), ["model_name", "is_correct"])


@job(TRAJ_SQL + ", long AS (" + " UNION ALL ".join(f"SELECT model_name, is_correct, '{c}' AS feature, {c}::DOUBLE AS value FROM traj" for c in RATIOS) + ")" + COMPARE_SQL.replace("coalesce((correct_mean - incorrect_mean) / nullif(sqrt(((n_correct - 1) * v1 + (n_incorrect - 1) * v0) / (n_correct + n_incorrect - 2)), 0), 0.0)", "(correct_mean - incorrect_mean) / greatest(sqrt(((n_correct - 1) * v1 + (n_incorrect - 1) * v0) / (n_correct + n_incorrect - 2)), 1e-9)") + f" SELECT model_name, feature, n_correct, n_incorrect, {', '.join(map(r, ['correct_mean', 'incorrect_mean', 'cohens_d', 'u']))} FROM effect")
def state_comparison(spark, sf_dir):
    """E8, with the second form of Cohen's d."""
    long = G.long_features(trajectories(spark, sf_dir), ["model_name"], RATIOS)
    c = G.group_comparison(long, ["model_name"], 1e-9)
    return rounded(c.select("model_name", "feature", "n_correct", "n_incorrect", "correct_mean", "incorrect_mean", "cohens_d", "u"))


COUPLE_SQL = "WITH " + T.TRANSITIONS + """, size AS (SELECT user_id, count(*) AS n_sentences FROM steps GROUP BY user_id HAVING count(*) >= 5),
events2 AS (SELECT m.model_name, m.user_id, m.is_correct, m.category, m.pos, n_sentences, min(t.idx) AS nxt
  FROM steps m JOIN size s ON s.user_id = m.user_id JOIN curve t ON t.user_id = m.user_id AND t.is_transition AND t.idx > m.pos WHERE m.category IS NOT NULL GROUP BY ALL),
coupled AS (SELECT model_name, user_id, is_correct, category, pos / n_sentences AS marker_position, nxt - pos AS distance, (nxt - pos) / n_sentences AS distance_normalized FROM events2)"""  # fmt: skip


def coupled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = T.steps(spark, sf_dir)
    found = curves.with_transitions(T.curve(spark, sf_dir), KEYS).filter("is_transition").select(*KEYS, F.col("idx").alias("pos"))
    sizes = s.groupBy(*KEYS).agg(F.count("*").alias("n_sentences"))
    return coupling.coupling_events(s.filter("category is not null").select(*KEYS, "pos", "category"), found, sizes, KEYS), sizes


@job(COUPLE_SQL + f" SELECT model_name, user_id, is_correct, category, distance, {r('marker_position')}, {r('distance_normalized')} FROM coupled")
def coupling_events(spark, sf_dir):
    """J1, J2."""
    return rounded(coupled(spark, sf_dir)[0])


SUMMARY_SQL = COUPLE_SQL + ", summary AS (SELECT model_name, category, count(*) AS n_events, avg(distance) AS mean_distance, count(*) FILTER (distance <= 3) AS within_near, 100.0 * count(*) FILTER (distance <= 3) / count(*) AS pct_within_near FROM coupled GROUP BY ALL)"


@job(SUMMARY_SQL + f" SELECT model_name, category, n_events, {r('mean_distance')}, within_near, {r('pct_within_near')} FROM summary")
def coupling_summary(spark, sf_dir):
    """G12."""
    return rounded(coupling.coupling_summary(coupled(spark, sf_dir)[0], ["model_name"]))


@job(SUMMARY_SQL + f""", chance AS (SELECT model_name, 300.0 / avg(n) AS chance_pct FROM (SELECT model_name, user_id, count(*) AS n FROM steps GROUP BY ALL) GROUP BY model_name)
SELECT model_name, {r('pct_within_near')}, {r('chance_pct')}, {r('pct_within_near / greatest(chance_pct, 0.1)', 'lift')}, pct_within_near > 2 * chance_pct AS strong FROM summary JOIN chance USING (model_name) WHERE category = 'revise'""")
def coupling_lift(spark, sf_dir):
    """G13."""
    events, sizes = coupled(spark, sf_dir)
    return rounded(coupling.lift_over_chance(coupling.coupling_summary(events, ["model_name"]), sizes, ["model_name"]))


PROFILE_SQL = "WITH " + T.TRACES + """, profiles AS (SELECT question_id, count(*) FILTER (is_correct) AS n_correct, count(*) FILTER (NOT is_correct) AS n_wrong,
coalesce(string_agg(model_name, ',' ORDER BY model_name) FILTER (is_correct), '') AS correct_models, coalesce(string_agg(model_name, ',' ORDER BY model_name) FILTER (NOT is_correct), '') AS wrong_models,
CASE WHEN count(*) FILTER (NOT is_correct) = 0 THEN 'easy' WHEN count(*) FILTER (is_correct) = 0 THEN 'hard' ELSE 'mixed' END AS difficulty FROM traces GROUP BY question_id HAVING count(DISTINCT model_name) = 3)"""  # fmt: skip


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.traces(spark, sf_dir).select("question_id", "model_name", "is_correct")
    return consensus.question_profiles(t).filter("n_correct + n_wrong >= 3").join(consensus.common_questions(t, 3), "question_id", "left_semi")


@job(PROFILE_SQL + " SELECT * FROM profiles")
def question_profiles(spark, sf_dir):
    """J3, J4."""
    return profiles(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("correct_models", "wrong_models")})


@job(PROFILE_SQL + " SELECT difficulty, count(*) AS n FROM profiles GROUP BY ALL")
def difficulty_summary(spark, sf_dir):
    """J6."""
    return profiles(spark, sf_dir).groupBy("difficulty").agg(F.count("*").alias("n"))


@job("WITH " + T.TRACES + """ SELECT a.model_name AS model_1, b.model_name AS model_2, round(avg((a.is_correct = b.is_correct)::INT), 6) + 0.0 AS agreement, count(*) AS n_common FROM traces a JOIN traces b USING (question_id)
WHERE question_id IN (SELECT question_id FROM traces GROUP BY 1 HAVING count(DISTINCT model_name) = 3) GROUP BY ALL""")  # fmt: skip
def model_agreement(spark, sf_dir):
    """J5, on questions common to all models."""
    t = T.traces(spark, sf_dir).select("question_id", "model_name", "is_correct")
    return rounded(consensus.agreement(t.join(consensus.common_questions(t, 3), "question_id", "left_semi")))


@job("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) + 0.0 AS value FROM events GROUP BY ALL")
def last_rows(spark, sf_dir):
    """J8."""
    e = T.read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return rounded(consensus.last_rows(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts"))


@job("WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, (-votes, event_type)) AS majority, max(votes) AS votes, round(max(votes) / sum(votes), 6) + 0.0 AS share FROM v GROUP BY user_id")
def majority_answers(spark, sf_dir):
    """R10."""
    return rounded(consensus.majority(T.read(spark, sf_dir, "events"), "user_id", "event_type"))


@job("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n) SELECT user_id, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, count(*) AS n_clusters FROM p GROUP BY user_id")
def semantic_entropy(spark, sf_dir):
    """Answers are events, clusters their types."""
    return rounded(consensus.semantic_entropy(T.read(spark, sf_dir, "events"), "user_id", "event_type"))


@job("WITH t AS (SELECT o_custkey AS question_id, 'm' || (o_orderkey % 3) AS model_name, o_totalprice AS seconds FROM orders) SELECT question_id, round(sum(seconds), 2) + 0.0 AS all_s, round(sum(seconds) FILTER (model_name = 'm0'), 2) + 0.0 AS one_s, round(sum(seconds) / sum(seconds) FILTER (model_name = 'm0'), 4) + 0.0 AS ratio FROM t GROUP BY ALL")
def cost_ratio(spark, sf_dir):
    """Orders as timed runs."""
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), F.concat(F.lit("m"), F.col("o_orderkey") % 3).alias("model_name"), F.col("o_totalprice").alias("seconds"))
    c = consensus.cost_ratio(o, "m0")
    return c.select("question_id", *[(F.round(x, d) + F.lit(0.0)).alias(x) for x, d in (("all_s", 2), ("one_s", 2), ("ratio", 4))])


SCORED = "scored AS (SELECT 'm' || (user_id % 3) AS model_name, least(value / 100, 1.0) AS p, event_type = 'purchase' AS y FROM events)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model_name"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"), (F.col("event_type") == "purchase").alias("y"))


@job("WITH " + SCORED + """, k AS (SELECT *, rank() OVER (PARTITION BY model_name ORDER BY p) + (count(*) OVER (PARTITION BY model_name, p) - 1) / 2.0 AS rk FROM scored)
SELECT model_name, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0, round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) + 0.0 AS auroc FROM k GROUP BY ALL""")  # fmt: skip
def auroc(spark, sf_dir):
    """R7."""
    return rounded(G.auroc(scored(spark, sf_dir), ["model_name"], "p", "y"))


@job("WITH " + SCORED + """, b AS (SELECT model_name, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(y::INT) AS acc, sum((p - y::INT) ** 2) AS sq FROM scored GROUP BY ALL)
SELECT model_name, round(sum(n * abs(conf - acc)) / sum(n), 6) + 0.0 AS ece, round(sum(sq) / sum(n), 6) + 0.0 AS brier, sum(n)::BIGINT AS n FROM b GROUP BY ALL""")  # fmt: skip
def calibration_error(spark, sf_dir):
    """R7."""
    return rounded(G.calibration_error(scored(spark, sf_dir), ["model_name"], "p", "y"))


@job("WITH " + T.TRANSITIONS + """ SELECT model_name, count(*) FILTER (is_transition AND event_type = 'error') AS hits, count(*) FILTER (is_transition) AS n_found, count(*) FILTER (event_type = 'error') AS n_true,
round(count(*) FILTER (is_transition AND event_type = 'error') / count(*) FILTER (is_transition), 6) + 0.0 AS precision, round(count(*) FILTER (is_transition AND event_type = 'error') / count(*) FILTER (event_type = 'error'), 6) + 0.0 AS recall FROM curve GROUP BY model_name""")  # fmt: skip
def detection_quality(spark, sf_dir):
    """Error events as annotated transitions."""
    s = T.steps(spark, sf_dir)
    found = curves.with_transitions(T.curve(spark, sf_dir), KEYS).filter("is_transition")
    truth = s.filter("event_type = 'error'").select("model_name", "user_id", F.col("pos").alias("idx"))
    return rounded(G.detection_quality(found, truth, ["model_name", "user_id", "idx"], ["model_name"]))


@job("WITH " + T.STEPS + """, p AS (SELECT model_name, state AS a, CASE WHEN sim < 0.2 THEN 'exploring' WHEN sim < 0.4 THEN 'committing' WHEN sim < 0.6 THEN 'verifying' ELSE 'backtracking' END AS b FROM steps),
o AS (SELECT model_name, count(*) AS n, avg((a = b)::INT) AS po FROM p GROUP BY ALL), ca AS (SELECT model_name, a AS c, count(*) AS na FROM p GROUP BY ALL), cb AS (SELECT model_name, b AS c, count(*) AS nb FROM p GROUP BY ALL),
e AS (SELECT model_name, sum(na * nb) AS s FROM ca JOIN cb USING (model_name, c) GROUP BY ALL)
SELECT model_name, round(po, 6) + 0.0 AS observed, round(s / (n * n), 6) + 0.0 AS expected, round((po - s / (n * n)) / (1 - s / (n * n)), 6) + 0.0 AS kappa FROM o JOIN e USING (model_name)""")  # fmt: skip
def annotator_kappa(spark, sf_dir):
    """States by event type against states by level."""
    level = F.when(F.col("sim") < 0.2, "exploring").when(F.col("sim") < 0.4, "committing").when(F.col("sim") < 0.6, "verifying").otherwise("backtracking")
    return rounded(G.kappa(T.steps(spark, sf_dir).withColumn("level", level), "state", "level", ["model_name"]))


@job(FEATURE_SQL + """, t AS (SELECT is_correct, normalized_commitment, n_transitions / n_steps AS density FROM features), q AS (SELECT quantile_cont(normalized_commitment, 0.33) AS c0, quantile_cont(normalized_commitment, 0.67) AS c1, quantile_cont(density, 0.33) AS d0, quantile_cont(density, 0.67) AS d1 FROM t)
SELECT CASE WHEN normalized_commitment <= c0 AND density <= d0 THEN 'early_silent' WHEN normalized_commitment >= c1 AND density >= d1 THEN 'late_noisy' ELSE 'oscillating' END AS mode, count(*) AS n, round(avg(is_correct::INT), 6) + 0.0 AS accuracy FROM t, q GROUP BY 1""")  # fmt: skip
def failure_modes(spark, sf_dir):
    """R5."""
    return rounded(G.failure_modes(features(spark, sf_dir).withColumn("density", F.col("n_transitions") / F.col("n_steps"))))


@job(FEATURE_SQL + """ SELECT model_name, question, idx, sim FROM (SELECT c.model_name, c.user_id AS question, c.idx, round(c.sim, 6) + 0.0 AS sim, row_number() OVER (PARTITION BY c.user_id ORDER BY c.idx) AS k, dense_rank() OVER (PARTITION BY c.model_name ORDER BY c.user_id) AS t FROM curve c WHERE is_transition) WHERE k <= 2 AND t <= 3""")
def top_examples(spark, sf_dir):
    """D4, examples of transitions (questions: ``mixed_examples``): of each model the first three traces with transitions, two of them each; the limits are the feature."""
    found = curves.with_transitions(T.curve(spark, sf_dir), KEYS).filter("is_transition")
    heads = found.withColumn("k", F.row_number().over(Window.partitionBy("model_name", "user_id").orderBy("idx"))).filter("k <= 2")
    # Ranked on one row per trace, after the first cut.
    first = heads.groupBy("model_name").agg(F.slice(F.array_sort(F.collect_set("user_id")), 1, 3).alias("chosen"))
    return rounded(heads.join(first, "model_name").filter(F.array_contains("chosen", F.col("user_id"))).select("model_name", F.col("user_id").alias("question"), "idx", "sim"))


@job(LONG_SQL + COMPARE_SQL + f""", best AS (SELECT model_name, count(*) FILTER (abs(cohens_d) > 0.2) AS n_strong, {r('avg(abs(cohens_d))', 'mean_abs_d')} FROM effect GROUP BY model_name)
SELECT model_name, n_strong, mean_abs_d, row_number() OVER (ORDER BY n_strong DESC, model_name) AS place FROM best""")
def best_models(spark, sf_dir):
    """Beside D2 (``best_by_p``): models (of which there are few) by the number of features with an effect, first on ties."""
    c = G.group_comparison(long_features(spark, sf_dir), ["model_name"])
    best = c.groupBy("model_name").agg(F.count_if(F.abs("cohens_d") > 0.2).alias("n_strong"), F.avg(F.abs("cohens_d")).alias("mean_abs_d"))
    return rounded(best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_strong"), "model_name"))))


@job(PROFILE_SQL + " SELECT question_id, n_correct, n_wrong, correct_models, wrong_models FROM profiles WHERE difficulty = 'mixed' ORDER BY question_id LIMIT 5")
def mixed_examples(spark, sf_dir):
    """The first five mixed questions in id order; the limit is the feature."""
    mixed = question_profiles(spark, sf_dir).filter("difficulty = 'mixed'")
    return mixed.select("question_id", "n_correct", "n_wrong", "correct_models", "wrong_models").orderBy("question_id").limit(5)


@job(TESTED_SQL + f", b AS (SELECT model_name, count(*) FILTER ({_SIGNIFICANT}) AS n_significant FROM tested GROUP BY model_name) SELECT model_name, n_significant, row_number() OVER (ORDER BY n_significant DESC, model_name) AS place FROM b")
def best_by_p(spark, sf_dir):
    """Models (of which there are few) by the number of significant features, first on ties."""
    best = feature_tests(spark, sf_dir).groupBy("model_name").agg(F.count_if("significant").alias("n_significant"))
    return rounded(best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_significant"), "model_name"))))


VECTOR_FEATURES = [f for f in FEATURES if f != "roughness"] + ["mean_drift_to_final"]
VKEYS = ["model_name", "embedding_model", "trace_id", "is_correct"]
VECTOR_SQL = FEATURE_SQL.replace(T.STEPS, T.EMBEDDED) + """, ends AS (SELECT trace_id, embedding_model, max(pos) AS last_pos, arg_max(vec, pos) AS last FROM emb GROUP BY ALL
), drift AS (
  SELECT trace_id || '-' || embedding_model AS user_id, avg(list_dot_product(vec, last) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(last, last)) + 1e-9)) AS mean_drift_to_final
  FROM emb JOIN ends USING (trace_id, embedding_model) WHERE pos < last_pos GROUP BY ALL
), vfeatures AS (SELECT *, split_part(user_id, '-', 2) AS embedding_model, split_part(user_id, '-', 1)::BIGINT AS trace_id FROM features JOIN drift USING (user_id) WHERE trace_length >= 3)"""  # fmt: skip
VLONG_SQL = VECTOR_SQL + ", long AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT model_name || '/' || embedding_model AS model_name, is_correct, '{f}' AS feature, {f}::DOUBLE AS value FROM vfeatures" for f in VECTOR_FEATURES) + ") WHERE value IS NOT NULL AND value <> -1)"


def embedded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.vector_features(T.embedded_steps(spark, sf_dir), VKEYS)


@job(VECTOR_SQL + f" SELECT model_name, embedding_model, trace_id, is_correct, n_transitions, trace_length, commitment_point, {', '.join(r(f) for f in VECTOR_FEATURES if f not in ('n_transitions', 'trace_length', 'commitment_point'))} FROM vfeatures")
def vector_features(spark, sf_dir):
    """The twelve features of every trace and embedding, from step vectors through curve and drift."""
    return rounded(embedded_features(spark, sf_dir).select(*VKEYS, *VECTOR_FEATURES))


def embedded_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = ["model_name", "embedding_model"]
    return G.group_comparison(G.long_features(G.enough_traces(embedded_features(spark, sf_dir), group), group, VECTOR_FEATURES), group)


@job(VLONG_SQL + COMPARE_SQL + f" SELECT split_part(model_name, '/', 1) AS model_name, split_part(model_name, '/', 2) AS embedding_model, feature, n_correct, n_incorrect, {', '.join(map(r, ['correct_mean', 'correct_std', 'incorrect_mean', 'incorrect_std', 'cohens_d', 'u', 'ties']))} FROM effect")
def vector_comparison(spark, sf_dir):
    """The flagship from vectors to statistics: V2, V3, V5-V12, V16, P4, G2, G4 and the statistic of G3."""
    return rounded(embedded_comparison(spark, sf_dir))


VTESTED_SQL = tested(VLONG_SQL + COMPARE_SQL + P_SQL)
_EMBEDDED = "split_part(model_name, '/', 1) AS model_name, split_part(model_name, '/', 2) AS embedding_model"


@job(VTESTED_SQL + f" SELECT {_EMBEDDED}, feature, {r('cohens_d')}, {r('p')}, {_SIGNIFICANT} AS significant FROM tested")
def embedding_effects(spark, sf_dir):
    """Model x embedding x feature with p-values and effect sizes."""
    return rounded(G.with_p(embedded_comparison(spark, sf_dir)).select("model_name", "embedding_model", "feature", "cohens_d", "p", "significant"))


@job(VTESTED_SQL + f", b AS (SELECT {_EMBEDDED}, count(*) FILTER ({_SIGNIFICANT}) AS n_significant, min(p) AS least_p, max(abs(cohens_d)) AS largest_d FROM tested GROUP BY tested.model_name) SELECT model_name, embedding_model, n_significant, {r('least_p')}, {r('largest_d')}, row_number() OVER (ORDER BY n_significant DESC, model_name, embedding_model) AS place FROM b")
def best_embedding(spark, sf_dir):
    """Model and embedding by number of significant features, first in order on ties."""
    return rounded(G.effect_by_group(G.with_p(embedded_comparison(spark, sf_dir)), ["model_name", "embedding_model"]))


@job(FEATURE_SQL + """ SELECT model_name, n_transitions, count(*) FILTER (is_correct) AS n_correct, count(*) FILTER (NOT is_correct) AS n_incorrect,
CASE WHEN count(*) < 5 THEN 'too_few_traces' WHEN least(count(*) FILTER (is_correct), count(*) FILTER (NOT is_correct)) < 2 THEN 'insufficient_group_size' END AS warning FROM features GROUP BY ALL""")  # fmt: skip
def group_warnings(spark, sf_dir):
    """Groups too small to be tested, of models and numbers of transitions."""
    return G.group_sizes(features(spark, sf_dir), ["model_name", "n_transitions"])


MODES_SQL = FEATURE_SQL + """, t AS (SELECT model_name, is_correct, normalized_commitment, n_transitions / n_steps AS density FROM features), q AS (SELECT quantile_cont(normalized_commitment, 0.33) AS c0, quantile_cont(normalized_commitment, 0.67) AS c1, quantile_cont(density, 0.33) AS d0, quantile_cont(density, 0.67) AS d1 FROM t),
modes AS (SELECT t.*, CASE WHEN normalized_commitment <= c0 AND density <= d0 THEN 'early_silent' WHEN normalized_commitment >= c1 AND density >= d1 THEN 'late_noisy' ELSE 'oscillating' END AS mode FROM t, q)"""


@job(MODES_SQL + f" SELECT model_name, mode, count(*) AS n, {r('avg(is_correct::INT)', 'accuracy')} FROM modes GROUP BY ALL")
def failure_mode_domains(spark, sf_dir):
    """R5 by domain, for which models stand."""
    return rounded(G.failure_modes(features(spark, sf_dir).withColumn("density", F.col("n_transitions") / F.col("n_steps")), ["model_name"]))


@job(MODES_SQL + f""", k AS (SELECT *, is_correct::INT AS y, rank() OVER (PARTITION BY mode ORDER BY density) + (count(*) OVER (PARTITION BY mode, density) - 1) / 2.0 AS rk FROM modes)
SELECT mode, count(*) AS n, {r('CASE WHEN count(*) >= 3 THEN coalesce(covar_pop(rk, y) / nullif(stddev_pop(rk) * stddev_pop(y), 0), 0.0) ELSE 0.0 END', 'rho')} FROM k GROUP BY mode""")  # fmt: skip
def mode_correlation(spark, sf_dir):
    """Correlation of density with correctness within each failure mode."""
    modes = G.with_modes(features(spark, sf_dir).withColumn("density", F.col("n_transitions") / F.col("n_steps")))
    return rounded(spearman(modes.withColumn("y", F.col("is_correct").cast("int")), ["mode"], "density", "y").select("mode", "n", "rho"))


@job("""WITH RECURSIVE e AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS b, abs(value - lead(value) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
both_ways AS (SELECT user_id, a, b FROM e WHERE gap < 2 AND a <> b UNION SELECT user_id, b, a FROM e WHERE gap < 2 AND a <> b),
reach AS (SELECT DISTINCT user_id, event_type AS a, event_type AS b FROM events UNION SELECT r.user_id, r.a, x.b FROM reach r JOIN both_ways x ON x.user_id = r.user_id AND x.a = r.b),
c AS (SELECT user_id, a AS event_type, min(b) AS cluster FROM reach GROUP BY ALL), n AS (SELECT user_id, cluster, count(*) AS n FROM events JOIN c USING (user_id, event_type) GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n)
SELECT user_id, round(-sum(p * ln(p)) + 1e-9, 6) + 0.0 AS entropy, count(*) AS n_clusters FROM p GROUP BY user_id""")  # fmt: skip
def equivalence_entropy(spark, sf_dir):
    """R6 from equivalences: event types are answers, alike where one follows the other with nearly its value."""
    e = T.read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = e.select("user_id", F.col("event_type").alias("a"), F.lead("event_type").over(order).alias("b"), F.abs(F.col("value") - F.lead("value").over(order)).alias("gap"))
    found = clusters.equivalence_clusters(Stages(spark, "clusters"), e, pairs.filter("gap < 2"), "user_id", "event_type")
    entropy = consensus.semantic_entropy(e.select("user_id", "event_type").join(found, ["user_id", "event_type"]), "user_id", "cluster")
    return rounded(entropy.withColumn("entropy", F.col("entropy") + 1e-9))  # off the sign of zero


@job("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)),
i AS (SELECT *, sum(CASE WHEN o_totalprice - before <= 10000 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS island FROM o),
n AS (SELECT o_custkey, island, count(*) AS n, min(o_orderkey) AS cluster FROM i GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY o_custkey) AS p FROM n)
SELECT o_custkey AS customer, sum(n)::BIGINT AS n_answers, count(*) AS n_clusters, max(n) AS largest, sum(cluster)::BIGINT AS clusters, round(-sum(p * ln(p)) + 1e-9, 6) + 0.0 AS entropy FROM p GROUP BY o_custkey""")  # fmt: skip
def order_clusters(spark, sf_dir):
    """R6 on customers with any number of answers: orders are answers, alike where the next dearer one costs at most 10,000 more."""
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("answer"), F.col("o_totalprice").alias("price"))
    order = Window.partitionBy("customer").orderBy("price", "answer")
    pairs = o.select("customer", F.col("answer").alias("a"), F.lead("answer").over(order).alias("b"), (F.lead("price").over(order) - F.col("price")).alias("gap")).filter("gap <= 10000")
    stages = Stages(spark, "clusters")
    found = stages.save(clusters.equivalence_clusters(stages, o, pairs, "customer", "answer"), "clusters")
    sizes = found.groupBy("customer", "cluster").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("customer").agg(F.sum("n").alias("n_answers"), F.max("n").alias("largest"), F.sum("cluster").alias("clusters"))
    entropy = consensus.semantic_entropy(found, "customer", "cluster").withColumn("entropy", F.col("entropy") + 1e-9)  # off the sign of zero
    return rounded(shape.join(entropy, "customer"))


@job(FEATURE_SQL + """ SELECT model_name, count(*) AS n_traces, round(100.0 * count(*) FILTER (n_transitions > 0) / count(*), 0) AS pct_with_transitions, round(avg(n_transitions), 1) AS mean_transitions, round(avg(mean_sim), 3) AS mean_similarity FROM features GROUP BY model_name""")
def transition_table(spark, sf_dir):
    """The first pilot's table as reports round it."""
    return transition_summary(spark, sf_dir).select("model_name", "n_traces", F.round("pct_with_transitions", 0).alias("pct_with_transitions"), F.round("mean_transitions", 1).alias("mean_transitions"), F.round("mean_similarity", 3).alias("mean_similarity"))


@job(VTESTED_SQL + f" SELECT {_EMBEDDED}, feature, {', '.join(f'round({c}, 3) AS {c}' for c in ('correct_mean', 'correct_std', 'incorrect_mean', 'incorrect_std', 'cohens_d'))}, round(p, 4) AS p, {_SIGNIFICANT} AS significant FROM tested WHERE least(n_correct, n_incorrect) >= 2")
def feature_table(spark, sf_dir):
    """The second pilot's table: means, deviations, p and effect as reports round them, without features of too few values."""
    t = G.with_p(embedded_comparison(spark, sf_dir)).filter("note is null")
    return t.select("model_name", "embedding_model", "feature", *[F.round(c, 3).alias(c) for c in ("correct_mean", "correct_std", "incorrect_mean", "incorrect_std", "cohens_d")], F.round("p", 4).alias("p"), "significant")
