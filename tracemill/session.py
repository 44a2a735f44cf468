"""What a Spark session needs before it runs functions of this package on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import tracemill

#: An Arrow batch to a Python worker has at most so many bytes, not just 10,000 rows, as texts may be long.
BATCH_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as ``--py-files`` would.

    Functions then travel by name and Python workers keep what modules remember between tasks. Batches to workers are bounded
    by ``BATCH_BYTES``; the setting stays, as results are computed after an operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    root = Path(tracemill.__file__).parent
    if getattr(context, "_tracemill_shipped", False) or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="tracemill-")
    stage = Path(folder, "tracemill")
    shutil.copytree(root, stage / "tracemill", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/tracemill-package", "zip", stage))
    context._tracemill_shipped = True
