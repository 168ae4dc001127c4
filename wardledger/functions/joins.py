"""Join keys that do not pile up on one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import col, non_blank

NO_MATCH = "\u0001"


def spread_null(key: Column | str, row_id: Column | str) -> Column:
    """``key``, with NULL replaced by many values that match nothing.

    An outer join sends every row without a key to the same partition. Here such rows are spread by
    a hash of the row's own name, which a retried task computes again.
    """
    return F.coalesce(col(key), F.concat(F.lit(NO_MATCH), F.xxhash64(col(row_id)).cast("string")))


def spread_blank(key: Column | str, row_id: Column | str) -> Column:
    """As ``spread_null``, for keys in which the empty string also means none."""
    return spread_null(non_blank(key), row_id)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which NULL keys are equal to each other, as they are in a group; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by one key alone.

    Joins, groups and windows on this key and further ones then find their rows in place, on every side that is dealt
    so: narrow rows move once, where each step would move them by its own keys. Spark leaves the step out for rows
    that lie so already. Keys are those of documents of bounded size (a claim's rows, a row's name), never a flag.
    """
    return df.repartition(key)


#: The sketch tells apart all keys that hold more than about a thousandth of the rows.
_TOP, _TRACKED = 1024, 16384
_EVEN = 8


def join_frequent(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    row_id: Column | str,
    how: str = "inner",
    counted: DataFrame | None = None,
    by: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """``left`` joined with the dimension ``right`` on ``keys``, in which a frequent key does not pile up on one task.

    A frequent-items sketch of the keys, one row of at most ``_TOP`` entries, gives each key that holds more than one of
    ``slices`` equal shares several slices for each share, so that they fill the tasks evenly. Its left rows are dealt to them by a hash of ``row_id``, its
    right rows are copied to each; all other rows have one slice. So each left row meets every right row of its key once,
    whatever the sketch says. ``counted`` gives the keys' frequencies where they are cheaper to read than from ``left``; ``by`` names
    the keys to count, by default all.
    NULL keys match nothing and are not spread here (``spread_null``); ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"right rows are copied, which a {how} join would show")
    slices = slices or 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = by or keys
    shares = _shares(left if counted is None else counted, by, slices)
    number = F.coalesce(F.element_at(F.col("_shares"), F.xxhash64(*by)), F.lit(1))
    dealt = left.withColumn("_shares", shares).withColumn("_slice", F.pmod(F.xxhash64(col(row_id), F.lit("slice")), number).cast("int"))
    copied = right.withColumn("_shares", shares).withColumn("_slice", F.explode(F.sequence(F.lit(0), number.cast("int") - 1)))
    return dealt.drop("_shares").join(copied.drop("_shares"), [*keys, "_slice"], how).drop("_slice")


def _shares(rows: DataFrame, keys: list[str], slices: int) -> Column:
    """A map from the hashes of the frequent keys to their numbers of slices, computed once as a scalar subquery."""
    hashes = rows.select(F.xxhash64(*keys).alias("_hash"))
    sketch = hashes.agg(F.expr(f"approx_top_k(_hash, {_TOP}, {_TRACKED})").alias("top"), F.count("*").alias("n"))
    frequent = F.filter("top", lambda e: e["count"] * slices > F.col("n"))
    entries = F.transform(frequent, lambda e: F.struct(e["item"], F.ceil(e["count"] * F.lit(_EVEN * slices) / F.col("n"))))
    return sketch.select(F.map_from_entries(entries)).scalar()
