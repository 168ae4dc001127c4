"""Extendible hashing: rows go to shards by hash prefix, and only oversized shards split on another bit.

A row's address is 64 bits long: 48 hash bits of its key, then 16 hash bits of its place among the rows, so that
rows of one key, too, can be told apart when their shard must split. The directory starts with one shard; a shard
over the byte limit splits in two on its next address bit until every shard fits or its bits are used up.

Splitting works on sums: bytes are first added up by the first ``step`` bits (at most 2**step sums), every prefix of
these gets its sum, and each address belongs to the shortest prefix that fits. Where a sum at the last bit is still
over the limit, its rows alone go through the next ``step`` bits. So each pass over the data adds up a bounded number
of sums for each shard still open, and rows are never moved to find their shard.

A row larger than the limit gets a shard of its own, marked ``oversized``. Null and empty texts have 0 bytes and are
sharded by their key; null keys hash as an empty text. Repeated rows are kept and may be told apart by the last 16
bits. An empty table gives no shards. The other columns of ``docs`` pass through; input columns named ``shard_id`` or
``shard_depth`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.session import Workspace

KEY_BITS, ROW_BITS = 48, 16
BITS = KEY_BITS + ROW_BITS


def address(key: Column, row: Column) -> Column:
    """64 characters 0 and 1: 48 bits of the key's md5, then 16 of the row's."""

    def bits(value: Column, n: int) -> Column:
        return F.lpad(F.conv(F.substring(F.md5(value.cast("string")), 1, n // 4), 16, 2), n, "0")

    return F.concat(bits(F.coalesce(key.cast("string"), F.lit("")), KEY_BITS), bits(row, ROW_BITS))


def split_shards(rows: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """The directory: ``shard_id`` (the prefix), ``bytes``, ``n_rows`` of each shard, from ``address`` and ``bytes``.

    No prefix of one shard begins another, and all addresses in ``rows`` have one.
    """
    space = Workspace(rows.sparkSession)
    spark = rows.sparkSession
    open_shards = spark.createDataFrame([("",)], "open string")
    found, depth = [], 0
    while depth < BITS:
        wide = min(step, BITS - depth)
        inside = rows.withColumn("open", F.substring("address", 1, depth))
        if depth:
            inside = inside.join(open_shards, "open", "left_semi")
        cells = inside.groupBy(F.substring("address", 1, depth + wide).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows")
        )
        cells = space.keep(cells, f"cells-{depth}")
        lengths = F.explode(F.sequence(F.lit(depth), F.lit(depth + wide)))
        prefixes = cells.withColumn("depth", lengths).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        sums = prefixes.groupBy("prefix", "depth").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        # The shortest prefix that fits; a prefix fits whatever its size where it holds one row or no bit is left.
        last = F.lit(depth + wide == BITS)
        fits = (F.col("bytes") <= limit) | (F.col("n_rows") == 1) | (last & (F.col("depth") == BITS))
        fitting = sums.filter(fits)
        parents = sums.filter(~fits).select(F.col("prefix").alias("parent"))
        whole = fitting.filter(F.col("depth") == depth) if depth == 0 else fitting.filter(F.lit(False))
        below = fitting.filter(F.col("depth") > depth).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
        level = below.join(parents, "parent", "left_semi").select("prefix", "bytes", "n_rows")
        level = space.keep(whole.select("prefix", "bytes", "n_rows").unionByName(level), f"shards-{depth}")
        found.append(level)
        over = cells.filter((F.col("bytes") > limit) & (F.col("n_rows") > 1)).select(F.col("cell").alias("open"))
        open_shards = space.keep(over, f"open-{depth}")
        depth += wide
        if open_shards.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("prefix", "shard_id")


def assign_shards(docs: DataFrame, limit: int, key_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``shard_id``, ``shard_depth`` (its number of bits) and ``oversized``.

    Rows find their shard by looking up the prefixes of their address, one join for each depth that has shards.
    """
    names = [c for c in docs.columns if c not in ("shard_id", "shard_depth", "oversized")]
    kept = docs.select(*names)
    size = F.coalesce(F.octet_length(F.col(text_column)), F.lit(0)).cast("long")
    place = F.monotonically_increasing_id()
    rows = kept.withColumn("__address", address(F.col(key_column), place)).withColumn("__bytes", size)
    directory = split_shards(rows.select(F.col("__address").alias("address"), F.col("__bytes").alias("bytes")), limit)
    directory = Workspace(docs.sparkSession).keep(directory, "directory")
    depths = sorted(r[0] for r in directory.select(F.length("shard_id")).distinct().collect())  # 65 at most
    cell = F.explode(F.array(*[F.expr(f"substring(__address, 1, {d})") for d in depths])) if depths else F.lit("")
    named = directory.select("shard_id", (F.col("bytes") > limit).alias("oversized"))
    found = rows.withColumn("shard_id", cell).join(named, "shard_id")
    return found.select(*names, "shard_id", F.length("shard_id").alias("shard_depth"), "oversized")


def shard_report(docs: DataFrame, limit: int) -> DataFrame:
    """Every document with its bytes and its shard."""
    return assign_shards(docs, limit).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard_id", "shard_depth", "oversized"
    )
