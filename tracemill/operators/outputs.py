"""From raw model outputs to thinking, answer and option (T1-T5, P5), by each model's settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.session import ship_package
from tracemill.stages import settled

#: A settings table of at most so many models goes out as a broadcast; beyond it the join shuffles.
BROADCAST_MODELS = 100_000
SETTINGS = {"has_think_tags": False, "tags_first": False, "kept_chars": 2000}


def with_settings(outputs: DataFrame, settings: DataFrame) -> DataFrame:
    """Adds has_think_tags, tags_first and kept_chars of each row's model; a model that isn't in the table has ``SETTINGS``."""
    table = settings.select(F.col("model_name").alias("_model"), *SETTINGS)
    few = table.limit(BROADCAST_MODELS + 1).count() <= BROADCAST_MODELS
    rows = outputs.drop(*SETTINGS).join(F.broadcast(table) if few else table, F.col("model_name") == F.col("_model"), "left").drop("_model")
    return rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in SETTINGS.items()})


def split_outputs(outputs: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Adds ``thinking`` and ``answer`` of ``raw_output``, and whether they can still hold repetitions (``loops``).

    Models by default: repetitions of the whole output go (T1), then it is split (T2). Models with ``tags_first``: chat tokens
    go (T3), closed think tags are split off before T1, which then is for the thinking alone; without such tags the
    default order follows. Each step's result is settled, so no later expression holds a copy of it, and T1's Python pass
    reads a text again only where an earlier pass found something: a part of a text without a block that comes three
    times has none either. Null outputs give nulls.
    """
    ship_package(outputs.sparkSession)
    rows = with_settings(outputs, settings) if settings is not None else outputs.withColumns({k: F.lit(v) for k, v in SETTINGS.items()})
    rows = settled(rows, _text=F.when(F.col("tags_first"), X.drop_special_tokens(F.col("raw_output"))).otherwise(F.col("raw_output")))
    rows = settled(rows, _tagged=F.col("tags_first") & F.col("_text").rlike(r"(?s)<think>.*?</think>"))
    rows = settled(rows, _whole=F.when(F.col("_tagged"), F.col("_text")).otherwise(X.remove_repetitions(F.when(~F.col("_tagged"), F.col("_text")))))
    rows = settled(rows, _parts=X.split_thinking(F.col("_whole"), F.col("has_think_tags") | F.col("tags_first")))
    loops = F.col("_tagged") | (F.col("_whole") != F.col("_text"))
    rows = rows.withColumns({"_thinking": F.col("_parts.thinking"), "answer": F.col("_parts.answer"), "loops": loops})
    again = F.col("tags_first") & F.col("loops")
    rows = settled(rows, thinking=F.when(again, X.remove_repetitions(F.when(again, F.col("_thinking")))).otherwise(F.col("_thinking")))
    return rows.drop("_text", "_tagged", "_whole", "_parts", "_thinking")


def predicted_options(parts: DataFrame) -> DataFrame:
    """T4 as graded, P5: adds ``predicted_option``, from the answer without its repetitions, else from the thinking without its own, and ``final_answer``.

    Both are cut in one Python pass, as each pass of a plan has a worker of its own in every task.
    """
    cut = lambda text: F.when(F.col("loops"), X.remove_repetitions(F.when(F.col("loops"), text))).otherwise(text)
    parts = settled(parts, _cut=F.struct(*[cut(F.col(c)).alias(c) for c in ("answer", "thinking")]))
    option = F.coalesce(X.predicted_option(F.col("_cut.answer")), X.predicted_option(F.col("_cut.thinking")))
    return parts.withColumns({"predicted_option": option, "final_answer": F.substring(F.col("answer"), F.lit(1), F.col("kept_chars"))}).drop("_cut")
