"""A training corpus in five stages: language, near-duplicates, contamination, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch, read_table
from tracemill.llm.decontaminate import decontaminate
from tracemill.llm.language import fit_languages, keep_known
from tracemill.llm.minhash import drop_near_duplicates
from tracemill.llm.mixing import mixed_documents
from tracemill.llm.quality import held_out
from tracemill.llm.token_output import tokens_of


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: no letter, or no codeword clearly nearest."""
    Scratch(spark, "language")
    return keep_known(spark, docs, fit_languages(spark, docs.filter(~held_out(F.col("doc_id"), 3, 1))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the benchmark's passages contaminate."""
    return decontaminate(spark, docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the mix: a document comes once per draw, shards apart and shuffled within. Of rows that repeat a doc_id each is drawn by itself."""
    return mixed_documents(spark, docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left, write it and report each document as the files have it."""
    return tokens_of(spark, docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Near-duplicates, language and tokens are not for SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again by the next; what the next has read is dropped."""
    scratch, docs, before = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads its own files
    scratch.drop(*before)
    return out
