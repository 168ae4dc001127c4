"""Tables that jobs change: whole versions, of which a version rewrites only the partitions it touches.

A version is a small file that names the folders of each partition. A job writes the partitions it changes to a folder of its
own, then publishes the next version by renaming its file into place, which fails if another job has published that
version before. So readers see one whole version or the other, a killed job leaves nothing but an unused folder, and a
job that is run again under the same ``run`` name finds its version and changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardledger.functions.joins import join_null_safe
from wardledger.session import materialize
from wardledger.sources.sinks import sized

_PART = "_part"
_WHOLE = "all"


class StaleBaseError(RuntimeError):
    """Another job has published a version since this one read its base."""


class VersionedTable:
    """A table below ``path`` with declared columns; ``part`` (a column expression) deals its rows to partitions."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: Column | None = None):
        self.spark, self.path, self.schema = spark, path, schema
        self.part = F.lit(_WHOLE) if part is None else part
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        if not self._files.exists(self._at(folder)):
            return []
        return [f.getPath().getName() for f in self._files.listStatus(self._at(folder))]

    def version(self) -> int:
        """The number of the latest version, 0 before the first."""
        return max((int(n) for n in self._names(f"{self.path}/versions") if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {"run": None, "parts": {}}
        stream = self._files.open(self._at(f"{self.path}/versions/{version}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest one."""
        return self._rows(self._manifest(self.version() if version is None else version)["parts"])

    def _rows(self, parts: dict[str, list[str]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for folders in parts.values() for f in folders])

    def _published_by(self, run: str) -> int | None:
        """The version that ``run`` has published, if any; its name is part of the data folders' names."""
        for version in range(self.version(), 0, -1):
            if self._manifest(version)["run"] == run:
                return version
        return None

    def upsert(self, changes: DataFrame, keys: list[str], run: str, base: int | None = None, deleted: DataFrame | None = None) -> int:
        """Publishes a version in which ``changes`` replace the rows of equal keys, and ``deleted`` keys are gone.

        Only partitions with such rows, before or after, are read and written. Keys are unique in ``changes``; NULL
        keys are equal to each other. Returns the version's number.
        """
        if (done := self._published_by(run)) is not None:
            return done
        base = self.version() if base is None else base
        parts = self._manifest(base)["parts"]
        new = materialize(changes.select(*self.schema.names))
        gone = new.select(*keys) if deleted is None else new.select(*keys).unionByName(deleted.select(*keys))
        gone = materialize(gone.distinct())
        held = join_null_safe(self._rows(parts), gone, keys, "left_semi").select(self.part.alias(_PART))
        touched = self._deal(new.select(self.part.alias(_PART)).unionByName(held).distinct().withColumn("at", F.lit(1)), "touched", run)
        rest = self._rows({p: f for p, f in parts.items() if p in touched})
        rows = join_null_safe(rest, gone, keys, "left_anti").unionByName(new)
        written = self._deal(rows.withColumn(_PART, self.part), "data", run)
        return self._publish(base, run, {**{p: f for p, f in parts.items() if p not in touched}, **written})

    def replace(self, rows: DataFrame, run: str, base: int | None = None) -> int:
        """Publishes ``rows``, which may be computed from the present version, as the whole table."""
        if (done := self._published_by(run)) is not None:
            return done
        base = self.version() if base is None else base
        return self._publish(base, run, self._deal(rows.select(*self.schema.names).withColumn(_PART, self.part), "data", run))

    def append(self, rows: DataFrame, run: str, base: int | None = None) -> int:
        """Publishes a version with further rows; nothing that is there is read or written."""
        if (done := self._published_by(run)) is not None:
            return done
        base = self.version() if base is None else base
        parts = self._manifest(base)["parts"]
        added = self._deal(rows.select(*self.schema.names).withColumn(_PART, self.part), "data", run)
        return self._publish(base, run, {p: [*parts.get(p, []), *added.get(p, [])] for p in {**parts, **added}})

    def _deal(self, rows: DataFrame, kind: str, run: str) -> dict[str, list[str]]:
        """Writes rows by partition; the folder of each. A folder of an earlier try is written over."""
        folder = f"{kind}/{run}"
        sized(rows, (_PART,)).write.mode("overwrite").partitionBy(_PART).parquet(f"{self.path}/{folder}")
        found = [n for n in self._names(f"{self.path}/{folder}") if n.startswith(f"{_PART}=")]
        return {n: [f"{folder}/{n}"] for n in found}

    def _publish(self, base: int, run: str, parts: dict[str, list[str]]) -> int:
        own = self._at(f"{self.path}/publishing/{run}")
        out = self._files.create(own, True)
        out.write(bytearray(json.dumps({"run": run, "parts": parts}).encode()))
        out.close()
        self._files.mkdirs(self._at(f"{self.path}/versions"))
        target = self._at(f"{self.path}/versions/{base + 1}")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(own, target, never_over)
        except Exception as error:
            if self._files.exists(target):
                raise StaleBaseError(f"version {base + 1} of {self.path} was published by another job") from error
            raise
        return base + 1
