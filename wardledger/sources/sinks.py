"""Writers for the outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def sized(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` dealt for writing: few files for each value of ``by``, none far above the session's target size.

    Adaptive planning cuts a large value into parts of ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and
    puts small ones together, from the measured sizes of the shuffle.
    """
    return df.hint("rebalance", *[F.col(c) for c in by])


# What a rerun of the same change may differ in.
RUN_COLUMNS = ("posting_date", "posting_time", "user_email", "edited_by")


def write_table(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists"
) -> None:
    """Parquet output; a table that is also an input is changed through ``VersionedTable`` instead."""
    writer = sized(df, partition_by).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_changes(changes: DataFrame, path: str) -> None:
    """Adds the change records that are not yet there, by claim year and month.

    A record's ``change_id`` is a hash of its content without the run's time and user, so a submission that
    is run again adds nothing.
    """
    content = [F.col(c) for c in sorted(changes.columns) if c not in RUN_COLUMNS]
    changes = changes.withColumn("change_id", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))
    spark = changes.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        known = spark.read.parquet(path).select("change_id")
        changes = changes.join(known, "change_id", "left_anti")
    by = ("claim_year", "claim_month")
    sized(changes, by).write.mode("append").partitionBy(*by).parquet(path)


def write_folio_documents(folios: DataFrame, path: str, column: str = "folio_json") -> None:
    """One JSON document per line."""
    sized(folios.select(column)).write.mode("errorifexists").text(path, lineSep="\n")
