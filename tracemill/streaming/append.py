"""S5 as a stream: trace files that arrive in a folder are cleaned, graded and appended once, whatever the target has grown to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.functions import text as X
from tracemill.session import ship_package
from tracemill.sources.traces import TRACE_SCHEMA
from tracemill.stages import settled

KEYS = ["model_name", "question_id"]


def cleaned(rows: DataFrame) -> DataFrame:
    """Stateless work on traces, for streams and tables alike: the option predicted (T4, repetitions removed), whether it is right (T5), lengths.

    ``is_correct`` is never null: without a prediction or a right option it is false.
    """
    ship_package(rows.sparkSession)
    rows = settled(rows, _option=F.coalesce("predicted_option", X.chosen_option(F.col("final_answer"), F.col("thinking_text"))))
    return rows.withColumns({
        "predicted_option": F.col("_option"), "is_correct": F.coalesce("is_correct", F.col("_option") == F.col("correct_option"), F.lit(False)),
        "thinking_char_count": F.coalesce("thinking_char_count", F.length("thinking_text")), "output_tokens": F.coalesce("output_tokens", F.lit(0)),
    }).drop("_option")


def _first_of_key(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The largest new row of a key that has not been there: the state of a key is that it was seen."""
    best = None
    for frame in frames:
        rows = frame.sort_values(list(frame.columns), na_position="first", key=lambda c: c.astype(str)).tail(1)
        best = rows if best is None or tuple(map(str, rows.iloc[0])) > tuple(map(str, best.iloc[0])) else best
    if not state.exists:
        state.update((True,))
        if best is not None and not bool(best["_known"].iloc[0]):
            yield best.drop(columns="_known")


def _begin(spark: SparkSession, target: str, folder: str) -> str:
    """The stream's name. When it begins, the keys of rows that are in ``target`` are written, as files that the stream reads like traces."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/name/_SUCCESS")):
        try:
            there = spark.read.parquet(target).select(*KEYS).distinct()
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            there = spark.createDataFrame([], "model_name string, question_id string")
        there.write.mode("overwrite").json(f"{folder}/keys")
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/name")
    return spark.read.text(f"{folder}/name").first()[0]


def append_stream(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Process all files now in ``source`` and stop; rows whose key was there before, in the target or in the stream, are left out.

    Keys that have been seen are the stream's state, in its checkpoint: a batch meets the state of its own keys and never the
    target, so its cost doesn't grow with it. Rows that were in the target before the stream began enter the state as the first
    thing that it reads; later the stream is the target's only writer. A batch writes a folder of the target as a whole, named after stream and batch, so
    one that is run again replaces what it wrote. Of rows with one key in a batch the largest, compared as text
    column by column, is taken.
    """
    name = _begin(spark, target, f"{checkpoint}-known")
    arrived = cleaned(spark.readStream.schema(TRACE_SCHEMA).json(source)).withColumn("_known", F.lit(False))
    before = spark.readStream.schema(TRACE_SCHEMA).json(f"{checkpoint}-known/keys").withColumn("_known", F.lit(True))
    both = arrived.unionByName(before.select(*arrived.columns))
    # A key that was known and comes in the same batch sorts as known: true is larger than false, and the column is first.
    rows = both.select("_known", *[c for c in both.columns if c != "_known"])
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_known").schema)
    found = rows.groupBy(*KEYS).applyInPandasWithState(_first_of_key, shape, "seen boolean", "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("model_name").parquet(f"{target}/batch={name}-{number}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
