"""Registered jobs on texts, questions and samples, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import ABBREVIATIONS, COMMON_MARKERS, COMMON_STATES, PARAMS, whole_words
from tracemill.functions import text as X
from tracemill.jobs import tables as T
from tracemill.jobs.analysis import VECTOR_SQL, VTESTED_SQL, embedded_comparison, embedded_features, r, rounded, t_tail_sql
from tracemill.operators import markers, sampling
from tracemill.operators import comparison as G
from tracemill.sources.results import merge_results
from tracemill.sources.traces import unseen
from tracemill.stages import Stages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LEXICON = whole_words(COMMON_MARKERS)


def job(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _abbreviations() -> str:
    out = "p"
    for a in ABBREVIATIONS:
        out = f"replace({out}, '{a}', '{a.replace('.', X.DOT)}')"
    return out


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: T6 without lookbehind: boundaries become a separator, then texts are cut at it.
SENTENCES = (
    T.TRACES
    + r""", paras AS (
  SELECT doc_id, i, """ + STRIP.format("string_split_regex(t, '\\n\\s*\\n')[i]") + r""" AS p FROM (
    SELECT doc_id, t, unnest(generate_series(1, len(string_split_regex(t, '\n\s*\n')))) AS i FROM (
      SELECT doc_id, regexp_replace(regexp_replace(replace(thinking_text, chr(13) || chr(10), chr(10)), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g') AS t
      FROM traces WHERE length(""" + STRIP.format("thinking_text") + r""") >= 10))
), cut AS (
  SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(""" + _abbreviations() + rf""", '(\d)\.(\d)', '\1{X.DOT}\2', 'g'), '(\d)\.(\d)', '\1{X.DOT}\2', 'g'),
    '([.!?。！？])\s+([A-Z\x{{4e00}}-\x{{9fff}}])', '\1' || chr(1) || '\2', 'g'), '([.!?。！？])\s*\n', '\1' || chr(1), 'g') AS p FROM paras
), parts AS (
  SELECT doc_id, i, j, """ + STRIP.format(f"replace(string_split(p, chr(1))[j], '{X.DOT}', '.')") + r""" AS s FROM (SELECT *, unnest(generate_series(1, len(string_split(p, chr(1))))) AS j FROM cut)
), items AS (
  SELECT doc_id, i, j, k, """ + STRIP.format("string_split(s, chr(1))[k]") + r""" AS sentence FROM (
    SELECT *, unnest(generate_series(1, len(string_split(s, chr(1))))) AS k FROM (
      SELECT doc_id, i, j, regexp_replace(s, '\n\s*(\d+[.)]\s|-\s|\*\s|•\s)', chr(1) || '\1', 'g') AS s FROM parts WHERE len(regexp_extract_all(s, '\S+')) >= 5))
), sentences AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) - 1 AS pos, sentence, len(regexp_extract_all(sentence, '\S+')) AS words FROM items WHERE len(regexp_extract_all(sentence, '\S+')) >= 5)"""
)
WORD_LIST = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: lower(w))"


def n_of(words: list[str], of: str = "w") -> str:
    return f"len(list_filter({of}, lambda x: x IN ({', '.join(repr(w) for w in words)})))"


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.traces(spark, sf_dir).select("doc_id", X.sentences(F.col("thinking_text")).alias("s"))
    return t.select("doc_id", F.posexplode_outer("s").alias("pos", "sentence")).filter("sentence is not null")  # see X.sentences


@job("WITH " + SENTENCES + " SELECT doc_id, count(*) AS n_sentences, sum(words)::BIGINT AS n_words, max(length(sentence)) AS longest, md5(string_agg(md5(sentence), '' ORDER BY pos)) AS digest FROM sentences GROUP BY doc_id")
def sentences(spark, sf_dir):
    """T6 on all texts; a digest of the sentences stands for them."""
    # One row per text, through a generator, so that the filter below can't take a copy of the split.
    t = T.traces(spark, sf_dir).select("doc_id", F.explode_outer(F.array(X.sentences(F.col("thinking_text")))).alias("s"))
    return t.select(
        "doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + X.word_count(x)).alias("n_words"),
        F.array_max(F.transform("s", F.length)).cast("long").alias("longest"), F.md5(F.array_join(F.transform("s", lambda x: F.md5(x.cast("binary"))), "").cast("binary")).alias("digest"),
    ).filter("n_sentences > 0")


@job("WITH " + SENTENCES + f""", c AS (SELECT doc_id, pos, words, {WORD_LIST.format('sentence')} AS w FROM sentences)
SELECT doc_id, pos, {' + '.join(n_of(w) for w in COMMON_MARKERS.values())} AS markers, words, round(({' + '.join(n_of(w) for w in COMMON_MARKERS.values())}) / words, 6) + 0.0 AS density FROM c""")  # fmt: skip
def step_density(spark, sf_dir):
    """Density of all categories together."""
    return rounded(markers.step_density(sentence_rows(spark, sf_dir), ["doc_id"], LEXICON))


_HITS = " UNION ALL ".join(f"SELECT doc_id, pos, '{c}' AS category FROM w WHERE {n_of(ws)} > 0" for c, ws in COMMON_MARKERS.items())
POSITION_SQL = "WITH " + SENTENCES + f", w AS (SELECT doc_id, pos, {WORD_LIST.format('sentence')} AS w FROM sentences WHERE doc_id IN (SELECT doc_id FROM traces WHERE length(thinking_text) >= 50)), hits AS ({_HITS})"


def text_traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sentences, markers by sentence) of texts of at least 50 characters."""
    t = T.traces(spark, sf_dir).filter(F.length("thinking_text") >= PARAMS.min_chars)
    t = t.select("model_name", "doc_id", F.explode_outer(F.array(X.sentences(F.col("thinking_text")))).alias("s"))
    t = t.select("model_name", "doc_id", F.size("s").alias("n_sentences"), F.posexplode_outer("s").alias("pos", "sentence")).filter("sentence is not null")
    return t, markers.marker_positions(t, ["model_name", "doc_id", "n_sentences"], LEXICON)


@job(POSITION_SQL + " SELECT doc_id, category, count(*) AS n_sentences, min(pos) AS first, max(pos) AS last FROM hits GROUP BY ALL")
def marker_positions(spark, sf_dir):
    """Sentences of each text that hold a category."""
    found = text_traces(spark, sf_dir)[1]
    return rounded(found.groupBy("doc_id", "category").agg(F.count("*").alias("n_sentences"), F.min("pos").alias("first"), F.max("pos").alias("last")))


_SCORE = {s: " + ".join(f"(list_contains(w, '{x}'))::INT" for x in ws) for s, ws in COMMON_STATES.items()}


@job("WITH " + SENTENCES + f""", c AS (SELECT doc_id, {WORD_LIST.format('sentence')} AS w FROM sentences), s AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _SCORE.items())} FROM c)
SELECT doc_id, CASE WHEN greatest({', '.join(_SCORE)}) = 0 THEN 'neutral' {' '.join(f"WHEN {k} = greatest({', '.join(_SCORE)}) THEN '{k}'" for k in _SCORE)} END AS state, count(*) AS n FROM s GROUP BY ALL""")  # fmt: skip
def sentence_states(spark, sf_dir):
    """Sentences of each text by state."""
    state = X.sentence_state(F.col("sentence"), whole_words(COMMON_STATES))
    return sentence_rows(spark, sf_dir).groupBy("doc_id", state.alias("state")).agg(F.count("*").alias("n"))


_REGIONS = {"all": ("thinking_text", "n"), "early": ("substr(thinking_text, 1, n // 2)", "greatest(n // 2, 1)"), "late": ("substr(thinking_text, n // 2 + 1)", "greatest(n // 2, 1)")}
DENSITY_SQL = "WITH " + T.TRACES + f""", t AS (SELECT doc_id, model_name, (NOT is_correct)::INT AS is_error, thinking_text, length(thinking_text) AS n FROM traces WHERE length(thinking_text) > 50),
w AS (SELECT doc_id, model_name, is_error, n, {', '.join(f'{WORD_LIST.format(x)} AS w_{k}, {m} AS n_{k}' for k, (x, m) in _REGIONS.items())} FROM t),
long AS ({' UNION ALL '.join(f"SELECT doc_id, model_name, is_error, '{k}' AS region, '{c}' AS category, {n_of(ws, f'w_{k}')} AS count, {n_of(ws, f'w_{k}')} * 1000.0::DOUBLE / n_{k} AS density FROM w" for k in _REGIONS for c, ws in COMMON_MARKERS.items())}
 UNION ALL SELECT doc_id, model_name, is_error, 'all', 'TOTAL', {' + '.join(n_of(ws, 'w_all') for ws in COMMON_MARKERS.values())}, {' + '.join(f"{n_of(ws, 'w_all')} * 1000.0::DOUBLE / n_all" for ws in COMMON_MARKERS.values())} FROM w)"""  # fmt: skip


def densities(spark: SparkSession, sf_dir: str, *regions: str) -> DataFrame:
    """Of the given regions, all by default."""
    return markers.marker_densities(T.traces(spark, sf_dir), ["doc_id", "model_name"], LEXICON, {k: markers.REGIONS[k] for k in regions or markers.REGIONS})


@job(DENSITY_SQL + f" SELECT doc_id, is_error::BIGINT AS is_error, region, category, count, {r('density')} FROM long")
def marker_densities(spark, sf_dir):
    """T7-T10."""
    return rounded(densities(spark, sf_dir).drop("model_name"))


RHO_SQL = DENSITY_SQL + """, k AS (SELECT *, rank() OVER (PARTITION BY model_name, region, category ORDER BY density) + (count(*) OVER (PARTITION BY model_name, region, category, density) - 1) / 2.0 AS rk FROM long),
rho AS (SELECT model_name, region, category, count(*) AS n, coalesce(covar_pop(rk, is_error) / nullif(stddev_pop(rk) * stddev_pop(is_error), 0), 0.0) AS rho,
coalesce(avg(density) FILTER (is_error = 0), 0.0) AS mean_density_correct, coalesce(avg(density) FILTER (is_error = 1), 0.0) AS mean_density_incorrect FROM k GROUP BY ALL)"""  # fmt: skip


def correlations(spark: SparkSession, sf_dir: str, *regions: str) -> DataFrame:
    return G.marker_correlations(densities(spark, sf_dir, *regions), ["model_name", "region", "category"])


@job(RHO_SQL + f" SELECT model_name, region, category, n, {r('rho')}, {r('mean_density_correct')}, {r('mean_density_incorrect')}, abs(rho) > 0.15 AS passes_rho FROM rho")
def marker_calibration(spark, sf_dir):
    """G6, G8."""
    return rounded(correlations(spark, sf_dir))


RHO_P_SQL = RHO_SQL + f", pr AS (SELECT *, CASE WHEN n < 3 OR rho = 0 THEN 1.0 WHEN abs(rho) >= 1 THEN 0.0 ELSE {t_tail_sql('rho', 'n')} END AS p FROM rho)"


@job(RHO_P_SQL + f" SELECT model_name, region, category, n, {r('rho')}, {r('mean_density_correct')}, {r('mean_density_incorrect')}, abs(rho) > 0.15 AS passes_rho, {r('p')} FROM pr")
def marker_tests(spark, sf_dir):
    """With p-values."""
    return rounded(G.with_rho_p(correlations(spark, sf_dir)))


@job(RHO_P_SQL + " SELECT model_name, category, round(rho, 3) AS rho, round(p, 4) AS p, round(mean_density_correct, 2) AS mean_density_correct, round(mean_density_incorrect, 2) AS mean_density_incorrect, abs(rho) > 0.15 AS passes_rho FROM pr WHERE region = 'all'")
def marker_table(spark, sf_dir):
    """The third pilot's table: correlations, p and densities of whole texts as reports round them."""
    t = G.with_rho_p(correlations(spark, sf_dir, "all"))
    return t.select("model_name", "category", F.round("rho", 3).alias("rho"), F.round("p", 4).alias("p"), *[F.round(c, 2).alias(c) for c in ("mean_density_correct", "mean_density_incorrect")], "passes_rho")


@job(RHO_SQL + f""" SELECT model_name, category, {r("max(rho) FILTER (region = 'early')", 'early_rho')}, {r("max(rho) FILTER (region = 'late')", 'late_rho')},
CASE WHEN abs(max(rho) FILTER (region = 'early')) > abs(max(rho) FILTER (region = 'late')) THEN 'EARLY' ELSE 'LATE' END AS stronger FROM rho WHERE region <> 'all' GROUP BY ALL""")  # fmt: skip
def early_or_late(spark, sf_dir):
    """G9."""
    return rounded(markers.early_or_late(correlations(spark, sf_dir)))


@job(RHO_SQL + f""", m AS (SELECT model_name, count(*) AS n_traces, count(*) FILTER (is_error = 0) AS n_correct FROM t GROUP BY ALL)
SELECT model_name, n_traces, n_correct, {r('n_correct / n_traces', 'accuracy')}, n_significant, {r('total_rho')} FROM m JOIN (SELECT model_name, count(*) FILTER (region = 'all' AND category <> 'TOTAL' AND abs(rho) > 0.15) AS n_significant, max(rho) FILTER (category = 'TOTAL') AS total_rho FROM rho GROUP BY ALL) USING (model_name)""")  # fmt: skip
def marker_summary(spark, sf_dir):
    """G10."""
    t = T.traces(spark, sf_dir).filter(F.length("thinking_text") > PARAMS.min_chars)
    base = t.groupBy("model_name").agg(F.count("*").alias("n_traces"), F.count_if("is_correct").alias("n_correct"))
    c = correlations(spark, sf_dir).groupBy("model_name").agg(
        F.count_if((F.col("region") == "all") & (F.col("category") != "TOTAL") & F.col("passes_rho")).alias("n_significant"), F.max(F.when(F.col("category") == "TOTAL", F.col("rho"))).alias("total_rho")
    )
    return rounded(base.join(c, "model_name").select("model_name", "n_traces", "n_correct", (F.col("n_correct") / F.col("n_traces")).alias("accuracy"), "n_significant", "total_rho"))


@job(RHO_SQL + f""" SELECT category, {r('avg(abs(rho))', 'mean_abs_rho')}, row_number() OVER (ORDER BY avg(abs(rho)) DESC, category) AS place FROM rho WHERE region = 'all' AND category <> 'TOTAL' GROUP BY category""")
def best_categories(spark, sf_dir):
    """D3: categories (a handful) by mean size of rho."""
    from pyspark.sql import Window

    c = correlations(spark, sf_dir, "all").filter("category <> 'TOTAL'").groupBy("category").agg(F.avg(F.abs("rho")).alias("mean_abs_rho"))
    return rounded(c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_abs_rho"), "category"))))


@job(RHO_SQL + """ SELECT count(DISTINCT model_name) FILTER (region = 'all' AND abs(rho) > 0.15) AS models_with_signal, count(DISTINCT model_name) FILTER (region = 'all' AND abs(rho) > 0.15) >= 2 AS passes FROM rho""")
def verdict(spark, sf_dir):
    """D1, third pilot (all three: ``verdicts``): do markers tell right from wrong for two models at least?"""
    n = F.count_distinct(F.when((F.col("region") == "all") & F.col("passes_rho"), F.col("model_name")))
    return correlations(spark, sf_dir, "all").agg(n.alias("models_with_signal"), (n >= PARAMS.models_passing).alias("passes"))


_PILOTS = [
    VECTOR_SQL + " SELECT count(*) AS n FROM (SELECT model_name, embedding_model FROM vfeatures GROUP BY ALL HAVING 100.0 * count(*) FILTER (n_transitions > 0) / count(*) > 50)",
    VTESTED_SQL + " SELECT count(*) AS n FROM tested WHERE least(n_correct, n_incorrect) >= 2 AND p < 0.05",
]


@job(" UNION ALL ".join(f"SELECT {k} AS pilot, n, n > 0 AS passes FROM ({q})" for k, q in enumerate(_PILOTS, 1)) + f" UNION ALL SELECT 3 AS pilot, n, n >= 2 AS passes FROM ({RHO_SQL} SELECT count(DISTINCT model_name) FILTER (region = 'all' AND abs(rho) > 0.15) AS n FROM rho)")
def verdicts(spark, sf_dir):
    """For each of the three pilots what counts, how many, and whether it passes: pairs of model and embedding with transitions in more than half of their
    traces; significant ones of their twelve features; models with a marker signal."""
    pair = ["model_name", "embedding_model"]
    share = 100.0 * F.count_if(F.col("n_transitions") > 0) / F.count("*")
    found = embedded_features(spark, sf_dir).groupBy(*pair).agg(share.alias("pct")).agg(F.count_if(F.col("pct") > PARAMS.pct_with_transitions).alias("n"))
    significant = G.with_p(embedded_comparison(spark, sf_dir)).agg(F.count_if("significant").alias("n"))
    pilots = [found.select(F.lit(1).alias("pilot"), "n", (F.col("n") > 0).alias("passes")), significant.select(F.lit(2).alias("pilot"), "n", (F.col("n") > 0).alias("passes"))]
    pilots.append(verdict(spark, sf_dir).select(F.lit(3).alias("pilot"), F.col("models_with_signal").alias("n"), "passes"))
    return rounded(pilots[0].unionByName(pilots[1]).unionByName(pilots[2]))


@job("WITH " + T.TRACES + r""", x AS (SELECT doc_id, model_name, is_correct, thinking_text AS t, regexp_replace(thinking_text, '^\s+|\s+$', '', 'g') AS s, regexp_replace(left(thinking_text, 500), '([^\p{L}\p{N}\p{M}_])', '\1\1', 'g') AS d FROM traces)
SELECT doc_id, coalesce(
  upper(nullif(regexp_extract(t, '\\boxed\{([A-E])\}', 1), '')),
  upper(nullif(regexp_extract(t, '(?i)(?:the answer is|answer:\s*|answer is)\s*\*?\*?\(?([A-E])\)?', 1), '')),
  upper(nullif(regexp_extract(t, '\*\*\(?([A-E])\)?\*\*', 1), '')),
  upper(nullif(regexp_extract(regexp_replace(split_part(s, chr(10), 1), '^\s+|\s+$', '', 'g'), '^\*?\*?\(?([A-E])\)?[.)\s:*]', 1), '')),
  (regexp_extract_all(d, '(?:^|[^\p{L}\p{N}\p{M}_])([A-E])(?:$|[^\p{L}\p{N}\p{M}_])', 1))[-1]) AS predicted_option FROM x""")  # fmt: skip
def predicted_options(spark, sf_dir):
    """T4."""
    return T.traces(spark, sf_dir).select("doc_id", X.predicted_option(F.col("thinking_text")).alias("predicted_option"))


@job("WITH " + T.TRACES + r""", x AS (SELECT doc_id, thinking_text AS t, length(thinking_text) - length(string_split(thinking_text, chr(10) || chr(10))[-1]) - 2 AS b, instr(thinking_text, chr(10)) AS first_line FROM traces)
SELECT doc_id, length(CASE WHEN b >= 0 THEN """ + STRIP.format("left(t, b)") + " ELSE t END) AS thinking_chars, length(" + STRIP.format("string_split(t, chr(10) || chr(10))[-1]") + ") AS answer_chars FROM x")  # fmt: skip
def split_traces(spark, sf_dir):
    """T2 (the texts have no headings or tags)."""
    t = T.traces(spark, sf_dir).select("doc_id", X.split_thinking(F.col("thinking_text"), F.lit(True)).alias("s"))
    return t.select("doc_id", F.length("s.thinking").cast("long").alias("thinking_chars"), F.length("s.answer").cast("long").alias("answer_chars"))


OPTIONS_SQL = "o AS (SELECT string_agg(chr(65 + r_regionkey) || ') ' || r_name, chr(10) ORDER BY r_regionkey) AS options_text FROM region)"


@job("WITH " + OPTIONS_SQL + """ SELECT c_custkey::BIGINT AS question_id, 'Where is ' || c_name || ' of ' || n_name || '?' || chr(10) || chr(10) || options_text AS prompt, chr(65 + n_regionkey) AS correct_answer, coalesce(r_name, '?') AS correct_text
FROM customer JOIN nation ON n_nationkey = c_nationkey CROSS JOIN o LEFT JOIN region ON r_regionkey = n_regionkey""")  # fmt: skip
def prompts(spark, sf_dir):
    """A question per customer with the regions as options."""
    letter = lambda c: F.char(F.lit(65) + F.col(c))
    options = T.read(spark, sf_dir, "region").agg(F.map_from_entries(F.collect_list(F.struct(letter("r_regionkey").alias("key"), F.col("r_name").alias("value")))).alias("options"))
    nations = T.read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").crossJoin(options)  # one row of options; a nation is a row of a fixed table
    q = T.read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(nations), "n_nationkey")
    prompt = X.fill("Where is {name} of {nation}?\n\n{options}", name=F.col("c_name"), nation=F.col("n_name"), options=X.options_text(F.col("options")))
    return q.select(F.col("c_custkey").cast("long").alias("question_id"), prompt.alias("prompt"), letter("n_regionkey").alias("correct_answer"), X.option_value(F.col("options"), letter("n_regionkey")).alias("correct_text"))


@job("WITH " + T.TRACES + """, o AS (SELECT question_id, chr((65 + doc_id % 3)::INT) AS key, min(coalesce(thinking_text, '')) AS value, bool_or(is_correct) AS is_right FROM traces GROUP BY ALL)
SELECT question_id, md5('Question ' || question_id || ': which text is right?' || chr(10) || chr(10) || string_agg(key || ') ' || value, chr(10) ORDER BY key)) AS prompt_md5, min(key) FILTER (is_right) AS correct_answer, md5(coalesce(min_by(value, key) FILTER (is_right), '?')) AS correct_md5 FROM o GROUP BY question_id""")  # fmt: skip
def trace_prompts(spark, sf_dir):
    """A question per group of traces, its whole texts as options; the first right one is the answer. Digests stand for the texts."""
    texts = T.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    right = T.read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_right"))
    t = texts.join(right, "doc_id", "left").withColumns({"question_id": F.expr("doc_id div 3"), "key": F.char(F.lit(65) + F.col("doc_id") % 3)})
    options = t.groupBy("question_id", "key").agg(F.min("value").alias("value"), F.bool_or(F.coalesce("is_right", F.lit(False))).alias("is_right"))
    q = options.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("options"), F.min(F.when(F.col("is_right"), F.col("key"))).alias("correct_answer"))  # three options at most
    prompt = X.fill("Question {id}: which text is right?\n\n{options}", id=F.col("question_id").cast("string"), options=X.options_text(F.col("options")))
    digest = lambda c: F.md5(c.cast("binary"))
    return q.select("question_id", digest(prompt).alias("prompt_md5"), "correct_answer", digest(X.option_value(F.col("options"), F.col("correct_answer"))).alias("correct_md5"))


@job("SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 20")
def pilot_sample(spark, sf_dir):
    """20 questions, by a seeded hash; the number is the feature."""
    return sampling.fixed_sample(T.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", PARAMS.pilot_questions, PARAMS.seed)


@job("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) <= 5")
def stratified_sample(spark, sf_dir):
    """Five of each source; the number is the feature."""
    return sampling.stratified_sample(T.read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5, PARAMS.seed)


@job("WITH " + T.TRACES + " SELECT t.model_name, count(*) AS n_new FROM traces t WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL")
def unseen_traces(spark, sf_dir):
    """Traces that have no label yet."""
    return unseen(T.traces(spark, sf_dir), T.read(spark, sf_dir, "labels"), ["doc_id"]).groupBy("model_name").agg(F.count("*").alias("n_new"))


@job("SELECT user_id, coalesce(b.n, a.n) AS n, CASE WHEN b.n IS NULL THEN 'old' ELSE 'new' END AS version FROM (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) a LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 100 GROUP BY ALL) b USING (user_id)")
def merged_results(spark, sf_dir):
    """A later result set over an earlier one, in place."""
    e = T.read(spark, sf_dir, "events")
    old = e.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("version", F.lit("old"))
    new = e.filter("event_type = 'error' and value > 100").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("version", F.lit("new"))
    path = f"{Stages(spark, 'results').root}/set"
    merge_results(old, path, ["user_id"])
    return merge_results(new, path, ["user_id"])


@job("SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), '\\s+((?:" + "|".join(sampling.PIVOTS) + ")\\b)', chr(1) || '\\1', 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '\\S+')) >= 10)) AS n_steps, len(regexp_extract_all(text, '(?is)I (?:initially|first) thought\\b.{0,200}?\\bbut\\b')) AS n_abandoned FROM documents")
def reasoning_steps(spark, sf_dir):
    """R1, R11."""
    d = T.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(sampling.reasoning_steps(F.col("text"))).cast("long").alias("n_steps"), sampling.abandoned(F.col("text")).cast("long").alias("n_abandoned"))


@job("WITH " + T.TRACES + f""", a AS (SELECT model_name, len(regexp_extract_all(thinking_text || ' I first thought it, ' || CASE WHEN doc_id % 5 = 0 THEN 'but no' ELSE 'and so' END, '(?is)I (?:initially|first) thought\\b.{{0,200}}?\\bbut\\b')) AS n FROM traces)
SELECT model_name, count(*) AS n_traces, sum(n)::BIGINT AS n_abandoned, {r('avg((n > 0)::INT)', 'share_abandoned')} FROM a GROUP BY ALL""")  # fmt: skip
def abandoned_branches(spark, sf_dir):
    """Per model the abandoned branches and the share of traces that have one; every text ends in a branch, of which some are abandoned."""
    t = T.traces(spark, sf_dir)
    ending = F.concat(F.lit(" I first thought it, "), F.when(F.col("doc_id") % 5 == 0, "but no").otherwise("and so"))
    return rounded(sampling.abandoned_share(t.withColumn("text", F.concat("thinking_text", ending)), "text", ["model_name"]))
