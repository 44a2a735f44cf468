"""The given tables as traces, questions, curves, states and step vectors, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as traces of three models; labelled ones of good quality are right."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.expr("doc_id div 3").alias("question_id"), F.concat(F.lit("m"), F.col("doc_id") % 3).alias("model_name"), "lang", "source",
        F.col("text").alias("thinking_text"), F.length("text").alias("thinking_chars"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_correct"),
    )


TRACES = """traces AS (
  SELECT d.doc_id, d.doc_id // 3 AS question_id, 'm' || (d.doc_id % 3) AS model_name, d.lang, d.source, d.text AS thinking_text,
         length(d.text) AS thinking_chars, coalesce(l.quality = 1, false) AS is_correct
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

#: Event types as epistemic states.
STATE_OF = {"click": "exploring", "purchase": "committing", "view": "verifying", "error": "backtracking", "signup": "neutral"}
#: Event types as marker categories.
MARKER_OF = {"click": "hedge", "error": "revise", "view": "verify"}


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order as the steps of a trace with a curve, a state and perhaps a marker."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    pick = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model_name"), "user_id", (F.col("user_id") % 2 == 0).alias("is_correct"), pos.alias("pos"), "event_type", "event_id",
        F.least(F.col("value") / 100, F.lit(1.0)).alias("sim"), pick(STATE_OF).alias("state"), pick(MARKER_OF).alias("category"),
    )


STEPS = """steps AS (
  SELECT 'm' || (user_id % 3) AS model_name, user_id, user_id % 2 = 0 AS is_correct, event_type, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, least(value / 100, 1.0) AS sim,
         CASE event_type WHEN 'click' THEN 'exploring' WHEN 'purchase' THEN 'committing' WHEN 'view' THEN 'verifying' WHEN 'error' THEN 'backtracking' ELSE 'neutral' END AS state,
         CASE event_type WHEN 'click' THEN 'hedge' WHEN 'error' THEN 'revise' WHEN 'view' THEN 'verify' END AS category
  FROM events)"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("model_name", "user_id", "is_correct", F.col("pos").alias("idx"), "sim")


TRANSITIONS = (
    STEPS
    + """, stats AS (
  SELECT *, pos AS idx, count(*) OVER w AS n, avg(sim) OVER w AS m, stddev_pop(sim) OVER w AS sd,
         lag(sim, 2) OVER o AS b2, lag(sim) OVER o AS b1, lead(sim) OVER o AS a1, lead(sim, 2) OVER o AS a2
  FROM steps WINDOW w AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY pos)
), near AS (
  SELECT * EXCLUDE (b2, b1, a1, a2), (coalesce(b2, 0) + coalesce(b1, 0) + coalesce(a1, 0) + coalesce(a2, 0)) AS ns,
         (b2 IS NOT NULL)::INT + (b1 IS NOT NULL)::INT + (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT AS nn FROM stats
), curve AS (
  SELECT *, n >= 3 AND ((sd > 0.01 AND (sim - m) / nullif(sd, 0) < -1.5) OR (nn > 0 AND ns / nullif(nn, 0) - sim > 0.15)) AS is_transition FROM near)"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 20 embeddings as the steps of a trace."""
    v = read(spark, sf_dir, "embeddings")
    trace = F.expr("vec_id div 20")
    return v.select(trace.alias("trace_id"), (F.col("vec_id") % 20).alias("pos"), F.col("embedding").alias("vec"), "label", (trace % 2 == 0).alias("is_correct"))


def embedded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of three models under two embedding models: whole vectors and their first half."""
    forms = F.array(F.struct(F.lit("full").alias("embedding_model"), F.col("vec")), F.struct(F.lit("half").alias("embedding_model"), F.slice("vec", 1, 32).alias("vec")))
    v = vectors(spark, sf_dir).withColumn("form", F.explode(forms))
    return v.select(F.concat(F.lit("m"), F.col("trace_id") % 3).alias("model_name"), "form.embedding_model", "trace_id", "is_correct", "pos", "form.vec")


VECTORS = "vectors AS (SELECT vec_id // 20 AS trace_id, vec_id % 20 AS pos, embedding::DOUBLE[] AS vec, label, (vec_id // 20) % 2 = 0 AS is_correct FROM embeddings)"

#: The same steps' curves, with a trace's and an embedding's name as one key.
EMBEDDED = VECTORS + """, emb AS (
  SELECT trace_id, pos, is_correct, 'full' AS embedding_model, vec FROM vectors UNION ALL SELECT trace_id, pos, is_correct, 'half', vec[1:32] FROM vectors
), pairs AS (SELECT *, lead(vec) OVER (PARTITION BY trace_id, embedding_model ORDER BY pos) AS nxt FROM emb
), steps AS (
  SELECT 'm' || (trace_id % 3) AS model_name, trace_id || '-' || embedding_model AS user_id, is_correct, pos,
         list_dot_product(vec, nxt) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(nxt, nxt))) AS sim FROM pairs WHERE nxt IS NOT NULL)"""


#: What stands for outputs of four models: texts with think tags, headings, loops and boxed answers around them, by number.
def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw outputs of four models, in eight forms so that every rule of T1-T4 has something to do."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t, head = F.col("t"), F.substring("t", 1, 90)
    loop = F.repeat(head, F.lit(4))
    forms = [
        F.concat(F.lit("<think>"), t, F.lit("</think>\nThe answer is B")), F.concat(t, F.lit("\n**Answer: (C)** it is")), F.concat(loop, F.lit("\n\nSo **D** then")),
        F.concat(t, F.repeat(F.lit("\n### Final Answer\nA. as said"), F.lit(3))), F.concat(t, F.repeat(F.lit(r" \\boxed{E} "), F.lit(4))),
        F.concat(F.lit("<think>"), loop, F.lit("</think> <|im_end|> It is \\boxed{A}")), F.concat(F.lit("<think>"), t), t,
    ]
    form = F.expr("(doc_id div 4) % 8")
    raw = F.coalesce(*[F.when(form == i, c) for i, c in enumerate(forms)])
    return d.select("doc_id", F.concat(F.lit("m"), F.col("doc_id") % 4).alias("model_name"), raw.alias("raw_output"))


OUTPUTS = r"""outputs AS (SELECT doc_id, 'm' || (doc_id % 4) AS model_name, CASE (doc_id // 4) % 8
  WHEN 0 THEN '<think>' || t || '</think>' || chr(10) || 'The answer is B' WHEN 1 THEN t || chr(10) || '**Answer: (C)** it is'
  WHEN 2 THEN repeat(left(t, 90), 4) || chr(10) || chr(10) || 'So **D** then' WHEN 3 THEN t || repeat(chr(10) || '### Final Answer' || chr(10) || 'A. as said', 3)
  WHEN 4 THEN t || repeat(' ' || chr(92) || chr(92) || 'boxed{E} ', 4) WHEN 5 THEN '<think>' || repeat(left(t, 90), 4) || '</think> <|im_end|> It is ' || chr(92) || 'boxed{A}'
  WHEN 6 THEN '<think>' || t ELSE t END AS raw_output FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""

#: Settings of three of them (the fourth has none): think tags or not, and which order of steps.
MODEL_SETTINGS = [("m0", False, False, 2000), ("m1", True, False, 2000), ("m2", True, True, 3000)]


def model_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_SETTINGS, "model_name string, has_think_tags boolean, tags_first boolean, kept_chars int")


SETTINGS = "settings AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}, {b}, {n})" for m, a, b, n in MODEL_SETTINGS) + ") s(model_name, has_think_tags, tags_first, kept_chars))"
