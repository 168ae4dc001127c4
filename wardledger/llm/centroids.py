"""Centroid clustering by Lloyd's rounds, sharded by dimension; all arithmetic on whole numbers.

Vectors are cut into chunks of rows, and each chunk into blocks of columns, one per shard. In a round every block meets
only its shard's slice of the centroids: a task computes the exact partial squared distances of its columns,
``reduceByKey`` adds the blocks of a chunk, and the smallest total gives each vector its cluster. The clusters go back
to the blocks, which stay where they are, and every shard adds up its own columns and updates its own slice. What moves
in a round is one number per vector, cluster and shard, and one cluster per vector and shard, never the vectors; the
driver holds the centroids (k times dimensions) and nothing that grows with the rows.

The blocks are written once to the shared folder, so a lost executor's part is read again and chunks keep their numbers.

Results of each case: vectors of another length than ``dims``, null ones and those with a null, NaN or infinite
component are left out. Others become floor(``scale`` * component). Repeated rows are vectors of their own and may both
become centroids; ids may be null. Ties go to the smaller cluster. With fewer than k vectors there are as many
centroids as vectors; an empty table gives no rows. An empty cluster keeps its centroid. Components of 2**26 and more
after scaling raise an error, as distances would leave 64 bits. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardledger.session import Workspace

_BLOCKS = "chunk long, shard int, ids array<long>, cells binary"
_LIMIT = 1 << 26
#: Rows of a chunk.
_CHUNK = 1024


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector: str) -> DataFrame:
    """id and cells (array of long) of the vectors that take part."""
    infinite = float("inf")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    kept = vectors.filter((F.size(vector) == dims) & F.forall(vector, sound))
    cells = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return kept.select(F.col(id_col).cast("long").alias("id"), cells.alias("cells"))


def first_centroids(whole: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id; ids without a hash (null) come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = whole.orderBy(order.asc_nulls_last(), "cells").limit(k).collect()
    return np.array([r.cells for r in rows], np.int64).reshape(len(rows), dims)


def column_blocks(whole: DataFrame, bounds: list[int]) -> DataFrame:
    """A row per chunk of vectors and shard, with the shard's columns; the first shard's rows carry the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(start, _CHUNK)
                cells = np.array(part.column("cells").flatten(), np.int64).reshape(part.num_rows, bounds[-1])
                if np.abs(cells).max() >= _LIMIT:
                    raise ValueError(f"a component is too large: {np.abs(cells).max()} after scaling, {_LIMIT} is the limit")
                blocks = [cells[:, a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                n = len(blocks)
                ids = [part.column("id").to_pylist(), *[None] * (n - 1)]
                columns = [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(blocks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "shard", "ids", "cells"])
                number += 1

    return whole.mapInArrow(run, _BLOCKS)


def _partial(cells: bytes, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centroids) within the columns of one block."""
    x = np.frombuffer(cells, "<i4").reshape(-1, centroids.shape[1]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _sums(cells: bytes, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sums (clusters, columns) of one block, and in a last column the clusters' sizes."""
    x = np.frombuffer(cells, "<i4").reshape(len(cluster), -1).astype(np.int64)
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    np.add.at(out, cluster, np.hstack([x, np.ones((len(x), 1), np.int64)]))
    return out


def _updated(sums: np.ndarray, old: np.ndarray) -> np.ndarray:
    """A shard's slice of the new centroids: exact floors, old values where a cluster is empty."""
    size = sums[:, -1:]
    return np.where(size > 0, sums[:, :-1] // np.maximum(size, 1), old)


def cluster_vectors(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    shards: int = 4,
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that takes part, and the final centroids (k, dims)."""
    spark = vectors.sparkSession
    space = Workspace(spark)
    whole = whole_vectors(vectors, dims, scale, id_col, vector)
    centroids = first_centroids(whole, k, seed, dims)
    bounds = np.linspace(0, dims, min(shards, dims) + 1).astype(int).tolist()
    slices = list(zip(bounds, bounds[1:], strict=False))
    kept = space.keep(column_blocks(whole, bounds), "blocks")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = kept.select("chunk", "shard", "cells").rdd.map(lambda r: ((r.chunk, r.shard), bytes(r.cells))).partitionBy(tasks, _place)

    def distances(now: np.ndarray):
        parts = [now[:, a:b] for a, b in slices]
        partial = blocks.map(lambda block: (block[0][0], _partial(block[1], parts[block[0][1]])))
        return partial.reduceByKey(np.add, tasks)

    for _ in range(rounds if len(centroids) else 0):
        n = len(slices)
        old = [centroids[:, a:b] for a, b in slices]
        size = len(centroids)
        clusters = distances(centroids).flatMap(
            lambda row, n=n: [((row[0], shard), row[1].argmin(axis=1).astype(np.int32)) for shard in range(n)]
        )
        sums = (
            blocks.join(clusters.partitionBy(tasks, _place), blocks.getNumPartitions())
            .map(lambda row, size=size: (row[0][1], _sums(*row[1], size)))
            .reduceByKey(np.add, min(n, tasks))
        )
        new = dict(sums.map(lambda row, old=old: (row[0], _updated(row[1], old[row[0]]))).collect())
        centroids = np.hstack([new.get(shard, old[shard]) for shard in range(n)])

    def nearest(row):
        chunk, total = row
        return chunk, total.argmin(axis=1).tolist(), total.min(axis=1).tolist()

    last = distances(centroids).map(nearest) if len(centroids) else []
    found = spark.createDataFrame(last, "chunk long, cluster array<int>, distance array<long>")
    ids = kept.filter("shard = 0").select("chunk", "ids")
    rows = ids.join(found, "chunk").select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("row"))
    named = rows.select(F.col("row.ids").alias(id_col), "row.cluster", "row.distance")
    return space.keep(named, "assigned"), centroids


def _place(key: tuple[int, int]) -> int:
    """Blocks of one chunk go to different tasks."""
    return hash(key)


def centroid_sha256(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """The clusters of all vectors, with the inertia of the cluster and of all, and the final centroid's digest."""
    assigned, centroids = cluster_vectors(vectors, **options)
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows
    digests = centroid_sha256(centroids)
    rows = [(c, total, sum(inertia.values()), digests[c]) for c, total in inertia.items()]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return assigned.join(F.broadcast(vectors.sparkSession.createDataFrame(rows, schema)), "cluster")
