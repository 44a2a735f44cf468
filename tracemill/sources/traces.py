"""Reading and writing questions and traces."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTION_SCHEMA = "question_id string, question string, options map<string,string>, answer_idx string"
HUB_SCHEMA = (
    "question string, options array<struct<key:string,value:string>>, answer_idx string, answer string, "
    "option_a string, option_b string, option_c string, option_d string"
)
TRACE_SCHEMA = (
    "question_id string, model_name string, raw_output string, thinking_text string, final_answer string, predicted_option string, "
    "correct_option string, is_correct boolean, generation_time_s double, output_tokens int, thinking_char_count int"
)


def _numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with ``_idx``, their number by file name, place of the split in the file, and line.

    Spark packs splits into partitions by size, but reads each in one go: the rows of a split are numbered by their running
    ids, and splits (one row each) get offsets from the counts of those before.
    """
    split = ["_file", "_begin"]
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_begin"), F.monotonically_increasing_id().alias("_row"))
    counts = rows.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    ahead = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # over one row per split
    before = counts.select(*split, "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return rows.join(before, split).withColumn("_idx", F.col("_before") + F.col("_row") - F.col("_first")).drop(*split, "_row", "_first", "_before")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines; a missing id becomes ``medqa_`` and the row's number in four digits."""
    rows = _numbered(spark, path, QUESTION_SCHEMA)
    return rows.select(
        F.coalesce("question_id", F.format_string("medqa_%04d", "_idx")).alias("question_id"), F.col("question").alias("clinical_vignette"), "options", F.col("answer_idx").alias("correct_answer")
    )


def read_hub(spark: SparkSession, path: str) -> DataFrame:
    """Questions as the hub has them, in JSON lines; ids are row numbers."""
    return normalise_hub(_numbered(spark, path, HUB_SCHEMA), "_idx")


def normalise_hub(rows: DataFrame, number: str) -> DataFrame:
    """Options to a map, from the list or else from the flat columns; answer ``answer_idx``, else ``answer``, else A.

    ``number`` names the column that has each row's place.
    """
    listed = F.map_from_entries(F.transform("options", lambda o: F.struct(o["key"], o["value"])))
    flat = F.map_from_arrays(F.array(*[F.lit(k) for k in "ABCD"]), F.array(*[F.coalesce(f"option_{k}", F.lit("")) for k in "abcd"]))
    return rows.select(
        F.format_string("medqa_%04d", number).alias("question_id"), F.col("question").alias("clinical_vignette"),
        F.when(F.coalesce(F.size("options"), F.lit(0)) > 0, listed).otherwise(flat).alias("options"), F.coalesce("answer_idx", "answer", F.lit("A")).alias("correct_answer"),
    )


def write_questions(questions: DataFrame, path: str) -> None:
    """S3."""
    questions.select("question_id", F.col("clinical_vignette").alias("question"), "options", F.col("correct_answer").alias("answer_idx")).write.mode("overwrite").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of all models below a folder (one directory each) with defaults for missing fields; P5 lengths."""
    rows = spark.read.schema(TRACE_SCHEMA).option("recursiveFileLookup", "true").json(path).filter("question_id is not null")
    return rows.withColumns({
        "thinking_char_count": F.coalesce("thinking_char_count", F.length("thinking_text")), "output_tokens": F.coalesce("output_tokens", F.lit(0)), "is_correct": F.coalesce("is_correct", F.lit(False)),
    })


def _same(names: list[str]) -> Column:
    """Equal keys of two sides, null equal to null."""
    return reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names])


def unseen(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key isn't there yet; failed rows count as there, and a null in a key equals a null."""
    return new.alias("a").join(existing.select(*keys).distinct().alias("b"), _same(keys), "left_anti")


def append_traces(new: DataFrame, path: str) -> int:
    """Append what is new, as a batch of its own with a directory per model; returns how many rows.

    Of new rows with one key, the one whose other columns are largest in order is taken, so that reruns agree.
    """
    spark = new.sparkSession
    keys = ["model_name", "question_id"]
    rest = [c for c in new.columns if c not in keys]
    try:
        new = unseen(new, spark.read.parquet(path), keys)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("row")).select(*keys, "row.*")
    n = new.count()
    if n:
        new.write.mode("overwrite").partitionBy("model_name").parquet(f"{path}/batch={uuid.uuid4().hex}")
    return n


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Analysis tables, each below its name; ``form`` is any of Spark's writers (``json`` for exchange)."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(form).save(f"{path}/{name}")


def merged(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New results replace old ones of the same key, other keys stay."""
    return unseen(existing, new, keys).unionByName(new)


def graded(traces: DataFrame, questions: DataFrame, predicted: str = "predicted_option") -> DataFrame:
    """Gold answers joined on; right if equal, wrong if nothing was predicted."""
    gold = questions.select("question_id", F.col("correct_answer").alias("correct_option"))
    return traces.drop("correct_option", "is_correct").join(gold, "question_id").withColumn("is_correct", F.coalesce(F.col(predicted) == F.col("correct_option"), F.lit(False)))
