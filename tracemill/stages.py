"""Intermediate tables that several consumers read: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a folder of its own, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stages:
    """Tables of one piece of work. What ``save`` returns is read from files, so lineage is short and lost executors cost a re-read.

    Who opens the stages closes them, by ``close`` or as a context, when results that read them have been taken; tables of
    results that are computed later go at the end of the program.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        atexit.unregister(self.close)
        if self.spark.sparkContext._jsc is not None:
            delete(self.spark, self.root)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as they are: each goes through a generator of one row, which no rule looks through."""
    for name, column in columns.items():
        df = df.withColumn("_settled", column).select("*", F.explode(F.array("_settled")).alias(name)).drop("_settled")
    return df
