"""Session settings and intermediate tables in the shared folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Let AQE split a hot join partition even where that costs one more shuffle.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: Spark removes an action's shuffle files at its end; frames that run again would compute them anew.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleanup_lock, _cleanups = threading.Lock(), []


def build_session(app: str = "wardledger", **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**TUNING, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` (or of ``setCheckpointDir``), which all executors share."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions begun inside leave no shuffle files on the disk. Jobs that run ``together`` may be inside at the same time."""
    with _cleanup_lock:
        if not _cleanups:
            _cleanups.append(spark.conf.get(SHUFFLE_CLEANUP, "false"))
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _cleanups.append(None)
    try:
        yield
    finally:
        with _cleanup_lock:
            _cleanups.pop()
            if len(_cleanups) == 1:
                spark.conf.set(SHUFFLE_CLEANUP, _cleanups.pop())


class Workspace:
    """Tables that a run writes for its own later steps, in a folder of its own below the shared one.

    Unlike a persisted frame such a table survives lost executors, and it cuts the lineage. Used as a
    context manager it removes its folder at the end; a caller that returns a lazy frame over a kept
    table leaves that folder to whoever clears the shared folder.
    """

    def __init__(self, spark: SparkSession, codec: str | None = None):
        """``codec`` is that of the tables' files, by default the session's."""
        self.spark = spark
        self._codec = codec or spark.conf.get("spark.sql.parquet.compression.codec")
        run = uuid.uuid4().hex
        self.path = f"{shared_folder(spark)}/run-{run}"
        self._prefix = f"kept_{run}"
        self._tables: dict[str, str] = {}  # bucketed tables, which the catalog knows

    def keep(
        self, df: DataFrame, name: str, by: tuple[str, ...] = (), dealt: bool = False
    ) -> DataFrame:
        """``df`` as a written table.

        With ``by`` it is bucketed by these columns, as many buckets as the session has shuffle partitions: joins and
        groups on these columns then read it without an exchange. Each bucket is one file; ``dealt`` frames, whose
        tasks hold few buckets each, are written as they are.

        What was shuffled for the table is removed from the disk once it is written: a job in steps needs the disk of its
        largest step, not of all.
        """
        path = f"{self.path}/{name}"
        if not by:
            with shuffles_removed(self.spark):
                df.write.parquet(path, compression=self._codec)
            return self.spark.read.schema(df.schema).parquet(path)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df if dealt else df.repartition(buckets, *by)
        table = f"{self._prefix}_{name}"
        with shuffles_removed(self.spark):
            rows.write.bucketBy(buckets, *by).option("path", path).option("compression", self._codec).saveAsTable(table)
        self._tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            self._forget(name)
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        for name in list(self._tables):
            self._forget(name)
        self._delete(self.path)

    def _forget(self, name: str) -> None:
        if name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(name)}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def together(*jobs: Callable[[], object]) -> list:
    """Runs jobs that don't need each other at the same time; their results in the given order."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [started.result() for started in [pool.submit(job) for job in jobs]]


def materialize(df: DataFrame, by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """Computes ``df`` once for several later uses, as a table in the shared folder, bucketed if ``by`` is given."""
    return Workspace(df.sparkSession, codec).keep(df, "kept", by)
