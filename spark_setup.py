"""What the entry points give a session that lacks it: a folder for intermediate tables, and the package's code."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """For local sessions without ``spark.checkpoint.dir`` names a folder that is removed at exit.

    On a cluster the setting names a folder that all executors share, and is left as it is. Sessions with Spark's
    default number of rows in an Arrow batch get a smaller one.
    """
    context = spark.sparkContext
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's default: too many long texts at once for a small executor
        spark.conf.set(ARROW_ROWS, "1000")
    if context.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        context.setCheckpointDir(_own_folder("wardledger-"))
    if not any(f.endswith("/wardledger.zip") for f in context.listFiles):
        package = Path(__file__).resolve().parent / "wardledger"
        folder = _own_folder("wardledger-code-")  # Spark serves the archive from here
        context.addPyFile(shutil.make_archive(f"{folder}/wardledger", "zip", package.parent, package.name))


def _own_folder(prefix: str) -> str:
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
