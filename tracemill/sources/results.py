"""Result sets that are replaced in place by key (S6): numbered versions of one table, of which readers see whole ones only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tracemill.sources.traces import merged

#: Versions that stay, for readers that began before the newest was there.
KEPT_VERSIONS = 2


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions, in order: those whose writer has left its mark of success."""
    files, folder = _files(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    found = sorted(int(m[1]) for m in (re.fullmatch(r"v(\d{8})", n) for n in names) if m)
    return [v for v in found if files.exists(_files(spark, f"{path}/v{v:08d}/_SUCCESS")[1])]


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version, or None where there is none yet."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]:08d}") if found else None


def merge_results(new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """New results replace old ones of the same key in the set at ``path``, other keys stay; returns the set as it now is.

    The merged table is written beside the one that it was made from, as the next version, and is there for readers when Spark's writer has
    committed it; a run that breaks off leaves a version that nobody reads and the next run overwrites, so a merge may
    be run again, and one that is run twice changes nothing. Older versions than ``KEPT_VERSIONS`` go. One writer at a time. Of
    new rows that repeat a key one stays, the largest in order of the other columns; nulls in a key are equal.
    """
    spark = new.sparkSession
    from pyspark.sql import functions as F

    rest = [c for c in new.columns if c not in keys]
    if rest:
        new = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("row")).select(*keys, "row.*")
    else:
        new = new.distinct()
    old, found = read_results(spark, path), versions(spark, path)
    number = (found[-1] if found else 0) + 1
    (merged(old, new, keys) if old is not None else new).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/v{number:08d}")
    files, _ = _files(spark, path)
    for v in found[: max(0, len(found) + 1 - KEPT_VERSIONS)]:
        files.delete(_files(spark, f"{path}/v{v:08d}")[1], True)
    return read_results(spark, path)
