"""Registered jobs on raw outputs: cleaned, split, options read and graded, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.jobs import tables as T
from tracemill.jobs.analysis import r, rounded
from tracemill.operators import consensus
from tracemill.operators.outputs import predicted_options as with_options
from tracemill.operators.outputs import split_outputs
from tracemill.session import ship_package
from tracemill.sources.traces import graded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def job(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def clean_sql(source: str, name: str) -> str:
    """T1 as CTEs, from ``source`` (doc_id, t) to ``name`` (doc_id, t): blocks of every length are grouped by their text."""
    final, box = r"(?i)###?\s*Final\s*Answer", r"\\\\boxed\{[^}]+\}"
    return rf"""{name}_k AS (SELECT doc_id, t, length(t) AS n, len(regexp_extract_all(t, '{final}')) > 2 AS finals, len(regexp_extract_all(t, '{box}')) > 3 AS boxes FROM {source}),
{name}_o AS (SELECT doc_id, t, n FROM {name}_k WHERE n >= 150 AND NOT finals AND NOT boxes),
{name}_h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, substr(t, i, 50) AS b FROM (SELECT doc_id, t, unnest(generate_series(1, n - 49)) AS i FROM {name}_o) GROUP BY ALL HAVING count(*) >= 3)),
{name}_w AS (SELECT doc_id, size, substr(t, i, size) AS b, min(i) AS a FROM (SELECT doc_id, t, size, unnest(generate_series(1, n - size + 1)) AS i FROM (SELECT doc_id, t, n, unnest(generate_series(50, 200, 10)) AS size FROM {name}_o SEMI JOIN {name}_h USING (doc_id)) WHERE n >= size) GROUP BY ALL HAVING count(*) >= 3),
{name}_p AS (SELECT doc_id, arg_min(b, (-size, a)) AS b, arg_min(a, (-size, a)) AS a FROM {name}_w JOIN {name}_o USING (doc_id) WHERE (n - length(replace(t, b, ''))) // size >= 3 GROUP BY doc_id),
{name} AS (SELECT k.doc_id, CASE WHEN n < 100 THEN t WHEN finals THEN {STRIP.format(r"regexp_extract(t, '(?is)^(.*?###?\s*Final\s*Answer.*?)###?\s*Final\s*Answer', 1)")}
  WHEN boxes THEN {STRIP.format(f"regexp_extract(t, '(?s)^(.*?{box}.*?{box})', 1)")} WHEN p.doc_id IS NOT NULL THEN {STRIP.format("left(t, p.a + length(p.b) - 2 + instr(substr(t, p.a + length(p.b)), p.b) + length(p.b))")} ELSE t END AS t
  FROM {name}_k k LEFT JOIN {name}_p p USING (doc_id))"""


def split_sql(source: str, name: str) -> str:
    """T2 as a CTE, from ``source`` (doc_id, t, tags) to ``name`` (doc_id, thinking, answer)."""
    heads = [p.replace("\n", r"\n") for p in X.ANSWER_HEADINGS]
    at = [f"CASE WHEN regexp_matches(t, '{p}') AND length(regexp_extract(t, '(?s)^(.*?){p}', 1)) > 100 THEN length(regexp_extract(t, '(?s)^(.*?){p}', 1)) END" for p in heads]
    return rf"""{name}_c AS (SELECT doc_id, t, tags AND regexp_matches(t, '(?s)<think>.*?</think>') AS tagged, least({', '.join(at)}) AS cut, length(t) - length(string_split(t, chr(10) || chr(10))[-1]) - 2 AS blank FROM {source}),
{name} AS (SELECT doc_id, CASE WHEN tagged THEN {STRIP.format("regexp_extract(t, '(?s)<think>(.*?)</think>', 1)")} WHEN cut IS NOT NULL THEN {STRIP.format("left(t, cut)")} WHEN blank >= 0 THEN {STRIP.format("left(t, blank)")} ELSE t END AS thinking,
  CASE WHEN tagged THEN {STRIP.format("regexp_extract(t, '(?s)<think>.*?</think>(.*)$', 1)")} WHEN cut IS NOT NULL THEN {STRIP.format("substr(t, cut + 1)")} ELSE {STRIP.format("string_split(t, chr(10) || chr(10))[-1]")} END AS answer FROM {name}_c)"""


def option_sql(source: str, name: str) -> str:
    """T4 as CTEs, from ``source`` (doc_id, t) to ``name`` (doc_id, option)."""
    return rf"""{name}_x AS (SELECT doc_id, t, {STRIP.format('t')} AS s, regexp_replace(left(t, 500), '([^\p{{L}}\p{{N}}\p{{M}}_])', '\1\1', 'g') AS d FROM {source}),
{name} AS (SELECT doc_id, coalesce(upper(nullif(regexp_extract(t, '\\boxed\{{([A-E])\}}', 1), '')), upper(nullif(regexp_extract(t, '(?i)(?:the answer is|answer:\s*|answer is)\s*\*?\*?\(?([A-E])\)?', 1), '')),
  upper(nullif(regexp_extract(t, '\*\*\(?([A-E])\)?\*\*', 1), '')), upper(nullif(regexp_extract({STRIP.format("split_part(s, chr(10), 1)")}, '^\*?\*?\(?([A-E])\)?[.)\s:*]', 1), '')),
  (regexp_extract_all(d, '(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])([A-E])(?:$|[^\p{{L}}\p{{N}}\p{{M}}_])', 1))[-1]) AS option FROM {name}_x)"""


def chosen_sql(parts: str, name: str) -> str:
    """T4 as graded, from ``parts`` (doc_id, thinking, answer) to ``name`` (doc_id, option)."""
    steps = [f"{name}_{p}0 AS (SELECT doc_id, {part} AS t FROM {parts}), {clean_sql(f'{name}_{p}0', f'{name}_{p}1')}, {option_sql(f'{name}_{p}1', f'{name}_{p}')}" for p, part in (("a", "answer"), ("t", "thinking"))]
    return f"{', '.join(steps)}, {name} AS (SELECT doc_id, coalesce({name}_a.option, {name}_t.option) AS option FROM {name}_a JOIN {name}_t USING (doc_id))"


def text_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, without chat tokens, as outputs of three models with think tags."""
    t = T.traces(spark, sf_dir)
    return t.select("doc_id", "question_id", "model_name", "is_correct", "thinking_chars", X.drop_special_tokens(F.col("thinking_text")).alias("raw_output"), F.col("thinking_text").alias("text"))


TEXT_OUTPUTS = "WITH " + T.TRACES + rf", raw AS (SELECT doc_id, {STRIP.format(r"regexp_replace(thinking_text, '<\|[^>]+\|>', '', 'g')")} AS t FROM traces), " + clean_sql("raw", "cleaned")
GRADED_SQL = TEXT_OUTPUTS + ", tagged AS (SELECT doc_id, t, true AS tags FROM cleaned), " + split_sql("tagged", "parts") + ", " + chosen_sql("parts", "chosen")


@job(TEXT_OUTPUTS + " SELECT doc_id, length(thinking_text) AS chars, length(t) AS kept_chars, md5(t) AS digest FROM cleaned JOIN traces USING (doc_id)")
def clean_traces(spark, sf_dir):
    """Outputs without degenerate repetitions."""
    ship_package(spark)
    t = T.traces(spark, sf_dir).select("doc_id", "thinking_text", X.remove_repetitions(X.drop_special_tokens(F.col("thinking_text"))).alias("cleaned"))
    return t.select("doc_id", F.length("thinking_text").cast("long").alias("chars"), F.length("cleaned").cast("long").alias("kept_chars"), F.md5(F.col("cleaned").cast("binary")).alias("digest"))


def options_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = spark.createDataFrame([(f"m{k}", True, False, 2000) for k in range(3)], "model_name string, has_think_tags boolean, tags_first boolean, kept_chars int")
    return with_options(split_outputs(text_outputs(spark, sf_dir), tagged))


@job(GRADED_SQL + """, o AS (SELECT question_id, chr((65 + doc_id % 3)::INT) AS key, bool_or(is_correct) AS is_right FROM traces GROUP BY ALL), gold AS (SELECT question_id, min(key) FILTER (is_right) AS correct_option FROM o GROUP BY question_id)
SELECT doc_id, model_name, option AS predicted_option, correct_option, coalesce(option = correct_option, false) AS is_correct FROM traces JOIN chosen USING (doc_id) JOIN gold USING (question_id)""")  # fmt: skip
def graded_traces(spark, sf_dir):
    """Outputs cleaned and split, options read from the answer and else from the thinking, and graded."""
    from tracemill.jobs.texts import trace_prompts

    t = options_of_texts(spark, sf_dir).select("doc_id", "question_id", "model_name", "predicted_option")
    return graded(t, trace_prompts(spark, sf_dir).select("question_id", "correct_answer")).select("doc_id", "model_name", "predicted_option", "correct_option", "is_correct")


@job(GRADED_SQL + f""" SELECT model_name, count(*) AS n_traces, count(*) FILTER (is_correct) AS n_correct, {r('avg(is_correct::INT)', 'accuracy')}, count(option) AS n_parsed, count(*) FILTER (starts_with(thinking_text, 'ERROR')) AS n_errors,
{r('avg(thinking_chars)', 'mean_chars')}, {r('avg(length(left(thinking_text, 2000)))', 'mean_kept')}, {r('avg(length(left(thinking_text, 3000)))', 'mean_kept_long')} FROM traces JOIN chosen USING (doc_id) GROUP BY ALL""")  # fmt: skip
def run_summary(spark, sf_dir):
    """Per model what was right, parsed and failed, from the options that the outputs give."""
    t = options_of_texts(spark, sf_dir)
    kept = {k: F.avg(F.length(X.kept_answer(F.col("text"), n))) for k, n in (("mean_kept", 2000), ("mean_kept_long", 3000))}
    return rounded(consensus.run_summary(t, **kept))


_MODEL_SQL = (
    "WITH " + T.OUTPUTS + ", " + T.SETTINGS + rf""", o AS (SELECT doc_id, model_name, coalesce(has_think_tags, false) AS has_tags, coalesce(tags_first, false) AS tags_first, coalesce(kept_chars, 2000) AS kept, CASE WHEN coalesce(tags_first, false) THEN {STRIP.format(r"regexp_replace(raw_output, '<\|[^>]+\|>', '', 'g')")} ELSE raw_output END AS t FROM outputs LEFT JOIN settings USING (model_name)),
f AS (SELECT *, tags_first AND regexp_matches(t, '(?s)<think>.*?</think>') AS tagged FROM o), whole0 AS (SELECT doc_id, t FROM f WHERE NOT tagged), """ + clean_sql("whole0", "whole1")
    + ", tagged AS (SELECT f.doc_id, coalesce(whole1.t, f.t) AS t, has_tags OR tags_first AS tags FROM f LEFT JOIN whole1 USING (doc_id)), " + split_sql("tagged", "split0")
    + ", inner0 AS (SELECT doc_id, thinking AS t FROM split0), " + clean_sql("inner0", "inner1")
    + ", parts AS (SELECT s.doc_id, CASE WHEN tags_first THEN i.t ELSE s.thinking END AS thinking, s.answer FROM split0 s JOIN inner1 i USING (doc_id) JOIN f USING (doc_id)), " + chosen_sql("parts", "chosen")
)


@job(_MODEL_SQL + " SELECT doc_id, model_name, md5(thinking) AS thinking_md5, length(thinking) AS thinking_chars, md5(left(answer, kept)) AS answer_md5, length(left(answer, kept)) AS answer_chars, option AS predicted_option FROM parts JOIN f USING (doc_id) JOIN chosen USING (doc_id)")
def model_outputs(spark, sf_dir):
    """T1-T4, P5 on outputs with tags, headings, loops and boxed answers, by a table of the models' settings (think tags, order of steps)."""
    t = with_options(split_outputs(T.outputs(spark, sf_dir), T.model_settings(spark)))
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return t.select(
        "doc_id", "model_name", digest("thinking").alias("thinking_md5"), F.length("thinking").cast("long").alias("thinking_chars"),
        digest("final_answer").alias("answer_md5"), F.length("final_answer").cast("long").alias("answer_chars"), "predicted_option",
    )
