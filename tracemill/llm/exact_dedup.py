"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch, fold_az, read_table

#: A key table of at most so many rows (about 25 bytes each) may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows of a group that meet its decision in one task, and groups that can be larger than their share of all rows.
GROUP_ROWS, HOT_GROUPS = 1000, 100_000


def duplicate_groups(spark: SparkSession, docs: DataFrame, prefix_chars: int = 64) -> tuple[DataFrame, DataFrame]:
    """Find documents whose texts are equal after lower-casing A-Z.

    Three tiers, each on what the one before left: documents alone with their length are unique; then those alone
    with (length, hash of the first ``prefix_chars`` characters); only the rest have their whole text read and hashed
    (SHA-256). Tiers one and two are aggregates with map-side combining, so a length or a prefix that a third of all
    rows share costs one row per task. The key table of the third tier is broadcast only below ``BROADCAST_ROWS``.

    Returns (groups, candidates): ``digest, keep_id, group_size`` for groups of two or more, and ``doc_id, digest`` of
    the documents whose text was read. Of a group, the largest doc_id stays. A null text is an empty text. A null doc_id never stays if its group has another; a group of null
    doc_ids only has keep_id null and kept true on each row. Rows that repeat a doc_id count each; the row kept is
    then every row of that doc_id. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(spark, "exact-dedup")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.octet_length(text).alias("len"),
        text.alias("body"),
    )
    small = lambda table: F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    lengths = scratch.save(rows.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len"), "lengths")
    alike = rows.join(small(lengths), "len", "left_semi").withColumn("head", F.xxhash64(fold_az(F.substring("body", 1, prefix_chars))))
    keys = scratch.save(alike.groupBy("len", "head").agg(F.count("*").alias("n")).filter("n > 1").select("len", "head"), "keys")
    full = alike.join(small(keys), ["len", "head"], "left_semi").select("doc_id", F.sha2(fold_az(F.col("body")), 256).alias("digest"))
    full = scratch.save(full, "full")
    groups = full.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return scratch.save(groups, "groups"), full


def with_groups(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """Rows (doc_id, digest) joined to their groups; a group that holds many rows is joined in several tasks.

    Groups larger than a share of 1 / ``HOT_GROUPS`` of all rows are fewer than ``HOT_GROUPS``, so their numbers of cuts may be
    broadcast.
    """
    least = max(GROUP_ROWS, (groups.agg(F.sum("group_size")).first()[0] or 0) // HOT_GROUPS)
    hot = groups.filter(F.col("group_size") > least).select("digest", F.ceil(F.col("group_size") / least).cast("int").alias("cuts"))
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts")
    salts = F.sequence(F.lit(0), F.when(F.col("group_size") > least, F.ceil(F.col("group_size") / least).cast("int")).otherwise(1) - 1)
    return rows.join(groups.withColumn("salt", F.explode(salts)), ["digest", "salt"], how).drop("salt")


def exact_dedup(spark: SparkSession, docs: DataFrame, prefix_chars: int = 64) -> DataFrame:
    """The documents of ``duplicate_groups``: doc_id, keep_id, group_size, kept, digest."""
    groups, full = duplicate_groups(spark, docs, prefix_chars)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return with_groups(full, groups, "inner").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group and the hash of its normalised text; cases as in ``duplicate_groups``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(spark, docs)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns for all documents: group decisions joined to the hash that every row must report."""
    groups, _ = duplicate_groups(spark, docs)
    every = docs.select("doc_id", F.sha2(fold_az(F.coalesce(F.col("text"), F.lit(""))), 256).alias("digest"))
    out = with_groups(every, groups, "left").withColumnRenamed("digest", "text_sha256")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"),
        "text_sha256",
    )


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
