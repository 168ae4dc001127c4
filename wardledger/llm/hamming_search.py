"""Exact k nearest binary codes by Hamming distance: incremental multi-index hashing.

A code is cut into segments of 16 bits, and each segment value leads to the codes that have it. A query looks up all
segment values within radius 0, 1, 2, ... of its own; after radius r every code within distance segments * (r + 1) - 1
has been seen, since a code further off in all segments is further off in total. The search stops as soon as the k-th
smallest verified distance is within that bound. Queries and codes are dealt in blocks of bounded size, every block
of queries meets every block of codes, and the blocks' answers are merged; each block's answer is exact.

Equal codes enter the index with their k smallest ids only: no answer can need more of them. Ties go to the smaller
id. A query finds itself too, at distance 0. Rows without an id or a code, and those whose code has another length
than ``bits``, neither ask nor answer; repeated rows count once. With fewer than k codes all of them are returned; an
empty table gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardledger.llm.batches import key_groups
from wardledger.session import Workspace

SEGMENT = 16
_CODES, _QUERIES = 1 << 16, 512
_MASKS: dict[int, np.ndarray] = {}


def masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    if not _MASKS:
        values = np.arange(1 << SEGMENT, dtype=np.uint32)
        bits = np.bitwise_count(values)
        _MASKS.update({r: values[bits == r] for r in range(SEGMENT + 1)})
    return _MASKS[radius]


class MultiIndex:
    """Codes (rows of 16-bit segments) by the value of each segment."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.first = [
            np.searchsorted(codes[o, s], np.arange((1 << SEGMENT) + 1)) for s, o in enumerate(self.order)
        ]

    def _at(self, segment: int, values: np.ndarray) -> np.ndarray:
        """The codes that have one of these values in a segment."""
        start, end = self.first[segment][values], self.first[segment][values + 1]
        n = end - start
        some = n > 0
        start, n = start[some], n[some]
        places = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.order[segment][places]

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes as near as the k-th nearest, at least."""
        segments = self.codes.shape[1]
        seen = np.zeros(len(self.codes), bool)
        places, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(SEGMENT + 1):
            found = np.concatenate([self._at(s, np.bitwise_xor(masks(radius), query[s])) for s in range(segments)])
            found = np.unique(found[~seen[found]])
            seen[found] = True
            places = np.concatenate([places, found])
            distances = np.concatenate([distances, np.bitwise_count(self.codes[found] ^ query).sum(axis=1).astype(np.int64)])
            covered = segments * (radius + 1) - 1
            if np.count_nonzero(distances <= covered) >= k or len(places) == len(self.codes):
                break
        return places, distances


def sign_codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``code``: one bit a dimension, set where it is above 0 (a null dimension is not)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [
                None if v is None else np.packbits(np.array([x is not None and x > 0 for x in v], bool)).tobytes()
                for v in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.binary())], ["id", "dim", "code"])

    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), F.size(vector_column).alias("dim"))
    kind = vectors.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(code, f"id {kind}, dim int, code binary")


def nearest_codes(codes: DataFrame, is_query: Column, k: int, bits: int) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``neighbor_id``, ``distance`` from ``codes`` (``id``, ``dim``, ``code``)."""
    if bits % SEGMENT:
        raise ValueError(f"bits must be a multiple of {SEGMENT}")
    space = Workspace(codes.sparkSession)
    usable = (F.col("dim") == bits) & F.col("id").isNotNull() & F.col("code").isNotNull()
    known = space.keep(codes.filter(usable).select("id", "code").distinct(), "codes")
    same = Window.partitionBy("code").orderBy("id")
    index = known.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k).drop("place")
    index = space.keep(index, "index")
    queries = known.filter(is_query)
    code_blocks, query_blocks = 1 + index.count() // _CODES, 1 + queries.count() // _QUERIES

    def dealt(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int, role: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id", "code"), F.lit(own_blocks)).cast("int"))
        return rows.withColumn(other, every).withColumn("role", F.lit(role)).select("qb", "cb", "role", "id", "code")

    pairs = dealt(index, "cb", code_blocks, "qb", query_blocks, 0).unionByName(
        dealt(queries, "qb", query_blocks, "cb", code_blocks, 1)
    )
    kind = known.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ("qb", "cb")):
            role = group.column("role").to_numpy()
            segments = np.frombuffer(b"".join(group.column("code").to_pylist()), ">u2").astype(np.uint32)
            segments = segments.reshape(len(role), bits // SEGMENT)
            ids = np.array(group.column("id").to_pylist(), object)
            names = ids[role == 0]
            index = MultiIndex(segments[role == 0])
            out: tuple[list, list, list] = ([], [], [])
            for name, query in zip(ids[role == 1], segments[role == 1], strict=True):
                places, distances = index.nearest(query, k)
                last = np.sort(distances)[min(k, len(distances)) - 1] if len(distances) else -1
                near = sorted((int(distances[i]), names[places[i]]) for i in np.flatnonzero(distances <= last))[:k]
                out[0].extend([name] * len(near))
                out[1].extend(n for _, n in near)
                out[2].extend(d for d, _ in near)
            id_type = group.schema.field("id").type
            columns = [pa.array(out[0], id_type), pa.array(out[1], id_type), pa.array(out[2], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "neighbor_id", "distance"])

    near = pairs.repartition("qb", "cb").sortWithinPartitions("qb", "cb", "role")
    near = near.mapInArrow(search, f"query_id {kind}, neighbor_id {kind}, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", "distance")


def search_report(embeddings: DataFrame, k: int = 10, bits: int = 64) -> DataFrame:
    """The k nearest sign codes of every vector whose id is divisible by 20."""
    codes = sign_codes(embeddings, "vec_id", "embedding")
    return nearest_codes(codes, F.col("id") % 20 == 0, k, bits)
