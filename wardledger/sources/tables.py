"""Access to the input tables by name, whatever store they come from."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.functions.columns import month_start
from wardledger.options import ReportFilters
from wardledger.sources.schemas import SCHEMAS, shaped
from wardledger.sources.sinks import write_table

#: The column that deals stored rows to a folder for each month of their table's date.
MONTH = "stored_month"
#: The date by which reports read a table.
DATED = {
    "patient_appointment": "appointment_date",
    "patient_encounter": "encounter_date",
    "inpatient_occupancy": "check_in",
    "inpatient_consultancy": "date",
    "sales_invoice": "posting_date",
}


class Tables:
    """Input tables as attributes (``t.patient_encounter``), opened on first use only.

    The loader gets a table name and returns its DataFrame. Stores whose columns are named
    differently pass ``renames={table: {stored_name: declared_name}}``.
    """

    def __init__(
        self,
        loader: Callable[[str], DataFrame],
        renames: Mapping[str, Mapping[str, str]] | None = None,
    ):
        self._loader = loader
        self._renames = renames or {}
        self._open: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        df = self._stored(name)
        return df.drop(MONTH) if MONTH in df.columns else df

    def in_months(self, name: str, filters: ReportFilters) -> DataFrame:
        """At least the rows of the filters' dates: where the table is stored by month, the folders of these months only."""
        df = self._stored(name)
        if MONTH not in df.columns:
            return df
        if filters.from_date:
            df = df.filter(F.col(MONTH) >= F.lit(filters.from_date.replace(day=1)))
        if filters.to_date:
            df = df.filter(F.col(MONTH) <= F.lit(filters.to_date))
        return df.drop(MONTH)

    def _stored(self, name: str) -> DataFrame:
        if name not in self._open:
            df = self._loader(name)
            for stored, declared in self._renames.get(name, {}).items():
                df = df.withColumnRenamed(stored, declared)
            self._open[name] = df
        return self._open[name]

    def with_tables(self, **replaced: DataFrame) -> Tables:
        """A copy in which some tables are replaced, e.g. by the output of an earlier job."""
        copy = Tables(self._loader, self._renames)
        copy._open = {**self._open, **replaced}
        return copy

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, **kwargs) -> Tables:
        """One parquet folder per table below ``root``, read with the declared schema.

        Those of ``DATED`` may be stored by month (``write_by_month``).
        """
        return cls(lambda n: spark.read.schema(SCHEMAS[n]).parquet(f"{root}/{n}"), **kwargs)

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        properties: Mapping[str, str],
        table_names: Mapping[str, str],
        partitioning: Mapping[str, tuple[str, str, str, int]] | None = None,
        **kwargs,
    ) -> Tables:
        """Tables of a relational database.

        ``partitioning`` gives (column, lower, upper, partitions) for tables too large for one
        connection; the others are read by one task.
        """
        partitioning = partitioning or {}

        def load(name: str) -> DataFrame:
            reader = spark.read.format("jdbc").options(url=url, dbtable=table_names[name], **properties)
            if name in partitioning:
                column, lower, upper, n = partitioning[name]
                reader = reader.options(
                    partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=n
                )
            return conform(reader.load(), name)

        return cls(load, **kwargs)

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Tables:
        return cls(lambda n: frames[n])


def write_by_month(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Stores a table of ``DATED`` below ``root``, a folder for each month; rows without a date are in one of their own."""
    write_table(df.withColumn(MONTH, month_start(DATED[name])), f"{root}/{name}", (MONTH,), mode)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast the declared columns to their declared types; missing ones become NULL."""
    return shaped(df, SCHEMAS[name], missing_as_null=True)
