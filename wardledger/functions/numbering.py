"""Running numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardledger.session import Workspace


def number_within(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str,
    after: DataFrame | None = None,
    partitions: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Number the rows of each group from 1 in the given (total) order.

    ``after`` holds the keys (once each) and a column ``last_no``: numbers of these groups go on from there. Its rows
    are sorted in as the first ones of their groups, with ``last_no`` as their weight, so nothing is joined.

    ``row_number`` over the group would put the whole group into one task. Instead the rows are computed once and
    written (unless ``stored`` says that ``df`` only reads written tables), cut into slices by ranges of group and order,
    and sorted; a large group covers several slices. The sorted slices are written as buckets, so counting within a
    slice moves no row. Only the first group of a slice can have begun before it: what it had there is added from the
    counts of the slices' first and last groups, two rows a slice.
    """
    space = Workspace(df.sparkSession)
    slices = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns({"_weight": F.lit(1).cast("long"), "_given": F.lit(1)})
    if after is not None:
        before = after.select(*keys, F.col("last_no").cast("long").alias("_weight"), F.lit(0).alias("_given"))
        rows = rows.unionByName(before, allowMissingColumns=True)
    if not stored:
        rows = space.keep(rows, "rows")
    sort = [*[F.col(k).asc_nulls_first() for k in keys], F.col("_given").asc(), *order]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sliced = space.keep(
        rows.repartitionByRange(slices, *sort)
        .sortWithinPartitions(*sort)
        .select("*", F.spark_partition_id().alias("_slice"), place.alias("_place")),
        "slices",
        by=("_slice",),
        dealt=True,
    )
    in_slice = Window.partitionBy("_slice", *keys).orderBy("_place")
    counted = sliced.withColumns({"_no": F.sum("_weight").over(in_slice), "_row": F.row_number().over(in_slice)})
    return (
        counted.join(_begun_before(sliced, keys), "_slice", "left")
        .withColumn("_first", F.col("_place") - F.col("_row") == -1)
        .withColumn(out, (F.col("_no") + F.when(F.col("_first"), F.coalesce("_before", F.lit(0))).otherwise(0)).cast("int"))
        .filter("_given = 1")
        .select(*df.columns, out)
    )


def _begun_before(sliced: DataFrame, keys: list[str]) -> DataFrame:
    """(_slice, _before): the weight of the slice's first group in the slices before it."""
    groups = sliced.groupBy("_slice", *keys).agg(F.sum("_weight").alias("_weight"), F.min("_place").alias("_at"))
    ends = F.struct("_at", "_weight", F.struct(*keys).alias("_group"))
    borders = groups.groupBy("_slice").agg(F.min_by(ends, "_at").alias("_a"), F.max_by(ends, "_at").alias("_z"))
    both = borders.select("_slice", F.inline(F.array_distinct(F.array("_a", "_z"))))
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_before", F.sum("_weight").over(earlier)).filter("_at = 0").select("_slice", "_before")
