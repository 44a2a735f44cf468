"""Registered jobs on the sentences of texts: one table of sentences, written and read back, serves all that a query does with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import COMMON_MARKERS, COMMON_STATES, PARAMS, whole_words
from tracemill.functions import text as X
from tracemill.jobs import tables as T
from tracemill.jobs.analysis import COMPARE_SQL, FEATURE_SQL, FEATURES, P_SQL, RATIOS, TRAJ_SQL, r, rounded
from tracemill.jobs.texts import _HITS, LEXICON, SENTENCES, WORD_LIST, _SCORE, n_of
from tracemill.operators import comparison as G
from tracemill.operators import coupling, curves, markers, states
from tracemill.operators.ranks import spearman
from tracemill.stages import Stages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["model_name", "doc_id", "is_correct"]
STATE_LEXICON = whole_words(COMMON_STATES)
#: Threshold of commitment on the given vectors, which are far from each other.
TAU = 0.1


def job(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sentence_table(spark: SparkSession, sf_dir: str, stages: Stages) -> DataFrame:
    """A row for each sentence of texts of at least 50 characters: keys, lang, n_sentences, pos, sentence. Split once and written."""
    t = T.traces(spark, sf_dir).filter(F.length("thinking_text") >= PARAMS.min_chars)
    t = t.select(*KEYS, "lang", F.explode_outer(F.array(X.sentences(F.col("thinking_text")))).alias("s"))
    rows = t.select(*KEYS, "lang", F.size("s").cast("long").alias("n_sentences"), F.posexplode_outer("s").alias("pos", "sentence")).filter("sentence is not null")
    return stages.save(rows, "sentences")


def with_vectors(spark: SparkSession, sf_dir: str, sentences: DataFrame) -> DataFrame:
    """Each sentence with the vector that stands for it, of all that the table has; only keys travel."""
    vectors = T.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    total = vectors.agg(F.count("*").alias("total"))  # one row
    steps = sentences.select(*KEYS, "pos").crossJoin(F.broadcast(total)).withColumn("vec_id", (F.col("doc_id") * 7 + F.col("pos")) % F.col("total"))
    return steps.join(vectors, "vec_id").select(*KEYS, "pos", "vec")


_OF = ", w AS (SELECT s.doc_id, s.pos, s.sentence, s.words, t.model_name, t.is_correct, t.lang, " + WORD_LIST.format("s.sentence") + " AS w FROM sentences s JOIN traces t ON t.doc_id = s.doc_id AND length(t.thinking_text) >= 50)"
_STATES = f", scored AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _SCORE.items())} FROM w)"
_STATE = f"CASE WHEN greatest({', '.join(_SCORE)}) = 0 THEN 'neutral' {' '.join(f"WHEN {k} = greatest({', '.join(_SCORE)}) THEN '{k}'" for k in _SCORE)} END"
STATE_STEPS = SENTENCES + _OF + _STATES + f", steps AS (SELECT model_name, doc_id AS user_id, is_correct, pos, {_STATE} AS state FROM scored)"
VECTOR_STEPS = SENTENCES + _OF + """, sv AS (SELECT w.*, e.embedding::DOUBLE[] AS vec, lead(e.embedding::DOUBLE[]) OVER (PARTITION BY w.doc_id ORDER BY w.pos) AS nxt, lead(w.sentence) OVER (PARTITION BY w.doc_id ORDER BY w.pos) AS after FROM w JOIN embeddings e ON e.vec_id = (w.doc_id * 7 + w.pos) % (SELECT count(*) FROM embeddings)),
steps AS (SELECT model_name, doc_id AS user_id, is_correct, lang, pos, sentence, after, list_dot_product(vec, nxt) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(nxt, nxt))) AS sim FROM sv WHERE nxt IS NOT NULL)"""  # fmt: skip
TEXT_TRAJ_SQL = TRAJ_SQL.replace(T.STEPS, STATE_STEPS)
TEXT_CURVE_SQL = "WITH " + T.TRANSITIONS.replace(T.STEPS, VECTOR_STEPS)
TEXT_FEATURE_SQL = FEATURE_SQL.replace(T.STEPS, VECTOR_STEPS)


def sentence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 on the table of sentences; states are written too, as trajectories and their comparison read them."""
    stages = Stages(spark, "states")
    rows = sentence_table(spark, sf_dir, stages)
    return stages.save(rows.select(*KEYS, "pos", X.sentence_state(F.col("sentence"), STATE_LEXICON).alias("state")), "states")


@job(TEXT_TRAJ_SQL + f" SELECT model_name, user_id AS doc_id, is_correct, n_sentences, final_state, {', '.join(map(r, RATIOS))} FROM traj")
def sentence_trajectories(spark, sf_dir):
    """From texts to trajectories of their sentences' states."""
    return rounded(states.trajectories(sentence_states(spark, sf_dir), KEYS))


@job("WITH " + STATE_STEPS + """, p AS (SELECT model_name, user_id, state, lead(state) OVER (PARTITION BY user_id ORDER BY pos) AS next FROM steps), k AS (SELECT user_id, state, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY ALL),
s AS (SELECT unnest(['exploring', 'committing', 'verifying', 'backtracking', 'neutral']) AS state), g AS (SELECT user_id, a.state, b.state AS next FROM (SELECT DISTINCT user_id FROM k), s a, s b),
m AS (SELECT g.user_id, g.state, g.next, coalesce(k.n / sum(k.n) OVER (PARTITION BY g.user_id, g.state), 0.0) AS p FROM g LEFT JOIN k ON g.user_id = k.user_id AND g.state = k.state AND g.next = k.next)
SELECT 'm' || (user_id % 3) AS model_name, state, next, round(avg(p) + 1e-9, 6) + 0.0 AS mean_p, count(*) AS n_traces FROM m GROUP BY ALL""")  # fmt: skip
def sentence_transition_matrix(spark, sf_dir):
    """E2 on sentences: each trace's matrix, averaged by model."""
    cells = states.transition_matrix(sentence_states(spark, sf_dir), ["model_name", "doc_id"])
    return rounded(cells.groupBy("model_name", "state", "next").agg((F.avg("p") + 1e-9).alias("mean_p"), F.count("*").alias("n_traces")))


@job(TEXT_TRAJ_SQL + " SELECT model_name, is_correct, final_state, count(*) AS n FROM traj GROUP BY ALL")
def sentence_final_states(spark, sf_dir):
    """E7 on sentences."""
    return states.final_state_counts(states.trajectories(sentence_states(spark, sf_dir), KEYS), ["model_name", "is_correct"])


@job(TEXT_TRAJ_SQL + ", long AS (" + " UNION ALL ".join(f"SELECT model_name, is_correct, '{c}' AS feature, {c}::DOUBLE AS value FROM traj" for c in RATIOS) + ")" + COMPARE_SQL.replace("coalesce((correct_mean - incorrect_mean) / nullif(sqrt(((n_correct - 1) * v1 + (n_incorrect - 1) * v0) / (n_correct + n_incorrect - 2)), 0), 0.0)", "(correct_mean - incorrect_mean) / greatest(sqrt(((n_correct - 1) * v1 + (n_incorrect - 1) * v0) / (n_correct + n_incorrect - 2)), 1e-9)") + f" SELECT model_name, feature, n_correct, n_incorrect, {', '.join(map(r, ['correct_mean', 'incorrect_mean', 'cohens_d', 'u']))} FROM effect")
def sentence_state_comparison(spark, sf_dir):
    """E8 on sentences: from texts to the comparison of right and wrong traces."""
    long = G.long_features(states.trajectories(sentence_states(spark, sf_dir), KEYS), ["model_name"], RATIOS)
    c = G.group_comparison(long, ["model_name"], 1e-9)
    return rounded(c.select("model_name", "feature", "n_correct", "n_incorrect", "correct_mean", "incorrect_mean", "cohens_d", "u"))


def curve_of(spark: SparkSession, sf_dir: str, sentences: DataFrame) -> DataFrame:
    return curves.similarity_curve(with_vectors(spark, sf_dir, sentences), KEYS)


@job(TEXT_CURVE_SQL + f" SELECT user_id AS doc_id, idx, {r('sim')}, sentence AS before, coalesce(after, '') AS after FROM curve WHERE is_transition")
def sentence_contexts(spark, sf_dir):
    """V2-V4 on texts: the sentences before and after each transition of the curve of their vectors."""
    rows = sentence_table(spark, sf_dir, Stages(spark, "contexts"))
    found = curves.with_transitions(curve_of(spark, sf_dir, rows), KEYS)
    return rounded(curves.transition_contexts(found, rows, KEYS, "pos", "sentence").select("doc_id", F.col("idx").cast("long").alias("idx"), "sim", "before", "after"))


TEXT_COUPLING_SQL = TEXT_CURVE_SQL + f""", hits AS ({_HITS}), size AS (SELECT doc_id, count(*) AS n_sentences FROM w GROUP BY doc_id),
coupled AS (SELECT *, nxt - pos AS distance FROM (SELECT 'm' || (h.doc_id % 3) AS model_name, h.doc_id, h.category, h.pos, min(t.idx) AS nxt FROM hits h JOIN size s ON s.doc_id = h.doc_id AND n_sentences >= 5 JOIN curve t ON t.user_id = h.doc_id AND t.is_transition AND t.idx > h.pos GROUP BY ALL)),
summary AS (SELECT model_name, category, count(*) AS n_events, avg(distance) AS mean_distance, count(*) FILTER (distance <= 3) AS within_near, 100.0 * count(*) FILTER (distance <= 3) / count(*) AS pct_within_near FROM coupled GROUP BY ALL)"""  # fmt: skip


def text_coupled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Markers of texts with the next transition of their sentences' vectors, and the number of sentences."""
    keys = ["model_name", "doc_id"]
    rows = sentence_table(spark, sf_dir, Stages(spark, "coupling"))
    found = markers.marker_positions(rows, [*keys, "n_sentences"], LEXICON)
    turns = curves.with_transitions(curve_of(spark, sf_dir, rows), KEYS).filter("is_transition").select(*keys, F.col("idx").alias("pos"))
    return coupling.coupling_events(found, turns, None, keys), rows.filter("pos = 0").select(*keys, "n_sentences")


@job(TEXT_COUPLING_SQL + f" SELECT model_name, category, n_events, {r('mean_distance')}, within_near, {r('pct_within_near')} FROM summary")
def text_coupling(spark, sf_dir):
    """From texts and sentence vectors to the coupling of markers with transitions."""
    return rounded(coupling.coupling_summary(text_coupled(spark, sf_dir)[0], ["model_name"]))


@job(TEXT_COUPLING_SQL + f""", chance AS (SELECT 'm' || (doc_id % 3) AS model_name, 300.0 / avg(n_sentences) AS chance_pct FROM size GROUP BY 1)
SELECT model_name, {r('pct_within_near')}, {r('chance_pct')}, {r('pct_within_near / greatest(chance_pct, 0.1)', 'lift')}, pct_within_near > 2 * chance_pct AS strong FROM summary JOIN chance USING (model_name) WHERE category = 'revise'""")  # fmt: skip
def text_coupling_lift(spark, sf_dir):
    """G13 on texts."""
    events, sizes = text_coupled(spark, sf_dir)
    return rounded(coupling.lift_over_chance(coupling.coupling_summary(events, ["model_name"]), sizes, ["model_name"]))


TEXT_LONG_SQL = TEXT_FEATURE_SQL + ", long AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT model_name, is_correct, '{f}' AS feature, {f}::DOUBLE AS value FROM features WHERE trace_length >= 3" for f in FEATURES) + ") WHERE value IS NOT NULL AND value <> -1)"


@job((TEXT_LONG_SQL + COMPARE_SQL + P_SQL + f" SELECT model_name, feature, n_correct, n_incorrect, {', '.join(map(r, ['correct_mean', 'incorrect_mean', 'cohens_d', 'u', 'p']))}, p < 0.05 AS significant FROM tested").replace("WITH ", "WITH RECURSIVE ", 1))
def text_feature_tests(spark, sf_dir):
    """The flagship from texts and step vectors to tests in one query: T6, P4, V2, V3, V5-V11, V15, V16, G2-G5."""
    rows = sentence_table(spark, sf_dir, Stages(spark, "features"))
    features = curves.trace_features(curve_of(spark, sf_dir, rows), KEYS).filter(F.col("trace_length") >= PARAMS.min_sentences)
    c = G.with_p(G.group_comparison(G.long_features(features, ["model_name"], FEATURES), ["model_name"]))
    return rounded(c.select("model_name", "feature", "n_correct", "n_incorrect", "correct_mean", "incorrect_mean", "cohens_d", "u", "p", "significant"))


_MARKED = " + ".join(n_of(ws) for ws in COMMON_MARKERS.values())
COMMITMENT_SQL = TEXT_FEATURE_SQL.replace("held >= 0.8", f"held >= {TAU}") + f""", d AS (SELECT doc_id, lang, pos, ({_MARKED}) / words AS density FROM w),
t AS (SELECT f.model_name, f.user_id AS doc_id, f.is_correct, d.lang, f.commitment_point, f.normalized_commitment, d.density FROM features f JOIN d ON d.doc_id = f.user_id AND d.pos = f.commitment_point),
q AS (SELECT quantile_cont(normalized_commitment, 0.33) AS c0, quantile_cont(normalized_commitment, 0.67) AS c1, quantile_cont(density, 0.33) AS d0, quantile_cont(density, 0.67) AS d1 FROM t),
modes AS (SELECT t.*, CASE WHEN normalized_commitment <= c0 AND density <= d0 THEN 'early_silent' WHEN normalized_commitment >= c1 AND density >= d1 THEN 'late_noisy' ELSE 'oscillating' END AS mode FROM t, q)"""  # fmt: skip


def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that commit, with the marker density of the sentence at which they do, and their mode."""
    stages = Stages(spark, "commitment")
    rows = sentence_table(spark, sf_dir, stages)
    places = curves.commitment(curve_of(spark, sf_dir, rows), KEYS, TAU)
    found = markers.density_at(markers.step_density(rows, [*KEYS, "lang"], LEXICON), places, KEYS, "commitment_point")
    return stages.save(G.with_modes(stages.save(found, "committed")), "modes")


@job(COMMITMENT_SQL + f" SELECT doc_id, lang, is_correct, commitment_point, {r('normalized_commitment')}, {r('density')}, mode FROM modes")
def commitment_density(spark, sf_dir):
    """Marker density at the sentence at which each trace commits, and the trace's mode."""
    return rounded(committed(spark, sf_dir).select("doc_id", "lang", "is_correct", "commitment_point", "normalized_commitment", "density", "mode"))


@job(COMMITMENT_SQL + f""", k AS (SELECT *, is_correct::INT AS y, rank() OVER (PARTITION BY lang, mode ORDER BY density) + (count(*) OVER (PARTITION BY lang, mode, density) - 1) / 2.0 AS rk FROM modes)
SELECT lang, mode, count(*) AS n, {r('avg(y)', 'accuracy')}, {r('CASE WHEN count(*) >= 3 THEN coalesce(covar_pop(rk, y) / nullif(stddev_pop(rk) * stddev_pop(y), 0), 0.0) ELSE 0.0 END', 'rho')} FROM k GROUP BY lang, mode""")  # fmt: skip
def commitment_modes(spark, sf_dir):
    """By language and mode, accuracy and the correlation of density at commitment with correctness."""
    rows = committed(spark, sf_dir).withColumn("y", F.col("is_correct").cast("int"))
    right = rows.groupBy("lang", "mode").agg(F.avg("y").alias("accuracy"))
    rho = spearman(rows, ["lang", "mode"], "density", "y").select(F.col("lang").alias("l"), F.col("mode").alias("m"), "n", "rho")
    return rounded(right.join(rho, F.col("lang").eqNullSafe(F.col("l")) & (F.col("mode") == F.col("m"))).select("lang", "mode", "n", "accuracy", "rho"))
