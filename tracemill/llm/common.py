"""Shared folder, materialised tables and batch sizing for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Session settings of these operators, which stay set, as results are computed after the operator has returned: Arrow batches
#: are bounded by bytes, as texts may be long, and an action's shuffle files go when it ends, as all that is read again has been
#: written to the shared folder.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset a local one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder for one run of an operator.

    ``save`` cuts the lineage: what it returns is read from files that survive lost executors.
    ``drop`` deletes the tables that the result no longer needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        ship_package(spark)
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


#: Id tables of at most so many rows (8 bytes each) may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


#: Tasks that write or send out a table of at most so many rows: its shuffle's partitions are read several to a task.
FEW_TASKS = 16


def if_few(counted: DataFrame, each: int = 1):
    """(hint, packed) for tables with at most ``each`` rows for a row of ``counted``.

    If these are at most ``BROADCAST_ROWS``, ``hint`` is ``F.broadcast`` and ``packed`` has ``FEW_TASKS`` tasks read the
    partitions of a shuffle; beyond, both leave a table as it is.
    """
    if counted.count() * each > BROADCAST_ROWS:
        return lambda df: df, lambda df: df
    return F.broadcast, lambda df: df.coalesce(FEW_TASKS)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keyed(scratch: Scratch, docs: DataFrame, ordered: bool = False) -> tuple[DataFrame, str]:
    """The documents, written, with a key of their own and its name; if ``ordered`` ascending with doc_id (nulls last) and text."""
    docs = docs.orderBy(F.asc_nulls_last("doc_id"), "text") if ordered else docs
    key = fresh(docs, "row_key")
    return scratch.save(docs.withColumn(key, F.monotonically_increasing_id()), "row-keyed"), key


def without_ids(scratch: Scratch, docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose ``key`` is not among the doc_ids of ``ids``; rows without a key stay."""
    name = fresh(docs, "gone_id")
    ids = scratch.save(ids.select(F.col("doc_id").cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct(), "gone")
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, F.col(key) == F.col(name), "left_anti")


def fold_az(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
