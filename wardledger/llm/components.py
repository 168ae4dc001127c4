"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardledger.session import Workspace


def connected_components(links: DataFrame, space: Workspace) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every linked node that isn't its own root.

    ``links`` has columns ``a`` and ``b``, in either order and repeated or not. Alternates two steps until nothing
    changes: link the larger neighbours of each node to its smallest neighbour, then its smaller ones. No step
    gathers a node's links in one place: neighbours meet only in a minimum and a join.
    """
    edges = space.keep(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links-0",
    )
    mark, step = None, 0
    while mark != (mark := _mark(edges)):
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = space.keep(large.filter("u != v").distinct(), f"large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = space.keep(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"links-{step}")
        space.drop(f"large-{step}", f"links-{step - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
