"""Best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens.

A document is its tokenizer ids and an end id; only a longer one is cut, into pieces of ``capacity`` tokens of which
the last may be shorter. Packing is bulk-synchronous best fit, longest pieces first: pieces and the sequences' gaps
stand sorted by size; a sweep gives each piece the next gap at or above its length (its successor); pieces that ask
for the same gaps are told apart by their rank; the gaps shrink and the sweep repeats, opening sequences where no gap
is left. Sizes are whole numbers up to ``capacity``, so both sorted lists are held as runs of equal size, whose
number depends on the capacity and not on the documents: a sweep step moves a whole run of pieces into a run of
gaps. The rows themselves are numbered within their length where they are made, by task and place in the task, and
find their sequence by that rank.

A null text is empty and has the end id only. Repeated rows are packed each for itself; rows are told apart by rank,
so ties and missing ids do no harm. An empty table gives no pieces. ``pack_pieces`` carries any further columns;
``token_pieces`` reads only the id and the text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardledger.llm.word_encoder import WordEncoder
from wardledger.llm.words import chunks, utf8
from wardledger.session import Workspace, materialize

CAPACITY = 2048
END = 0


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The pieces of all documents: id, ``piece``, ``start``, ``length`` and ``ids`` (little-endian 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.load(tokenizer)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in chunks(texts):
                rows, piece, start, ids = [], [], [], []
                for i, encoded in enumerate(encoder.encode(texts[a:b]), a):
                    encoded += last
                    for k, at in enumerate(range(0, len(encoded), 4 * capacity)):
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        ids.append(encoded[at : at + 4 * capacity])
                lengths = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), lengths]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_column)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, first sequence, offset) of each step.

    From its first rank on, up to the next step of that length, rank r goes to sequence ``first + r - first rank``.
    """
    steps, opened = [], 0
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, how many)
    gaps: list[int] = []  # those that have runs, sorted

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
            runs.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            successor = bisect_left(gaps, length)
            if successor == len(gaps):
                wanted = -(-left // (capacity // length))
                free(capacity, opened, wanted)
                opened += wanted
                continue
            gap = gaps[successor]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[successor]
            moved = min(left, n)
            steps.append((length, rank, first, capacity - gap))
            free(gap - length, first, moved)
            free(gap, first + moved, n - moved)
            rank, left = rank + moved, left - moved
    return steps


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) and their ``sequence_id`` and ``offset``, which replace columns of these names.

    ``pieces`` is computed once and kept as a table, each row with its task and its rank among the task's pieces of its
    length. Counts by task and length then give every row its rank in the whole table: no row is sorted or sent to
    the others of its length. A length that is null, not positive or beyond the capacity is an error.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    inner = [f"c{i}" for i in range(len(names))]
    kinds = [pieces.schema[c].dataType for c in names]
    rows = pieces.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(names, inner, strict=True)], F.col("length").cast("long").alias("size"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            size = batch.column("size").fill_null(0).to_numpy(zero_copy_only=False)
            if len(size) and not 1 <= size.min() <= size.max() <= capacity:
                raise ValueError(f"lengths must be from 1 to {capacity}")
            order = np.argsort(size, kind="stable")
            counts = np.bincount(size, minlength=capacity + 1)
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) + np.repeat(seen - np.cumsum(counts) + counts, counts)
            seen += counts
            more = [pa.array(np.full(len(size), part, np.int64)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "rank"])

    fields = [T.StructField(a, t) for a, t in zip(inner, kinds, strict=True)]
    longs = [T.StructField(c, T.LongType()) for c in ("size", "part", "rank")]
    ranked = Workspace(pieces.sparkSession).keep(rows.mapInArrow(number, T.StructType(fields + longs)), "pieces")
    counts = ranked.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = counts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    lengths = ranked.groupBy("size").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    steps = sorted(best_fit({r["size"]: r["n"] for r in lengths}, capacity))
    places = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
    if not steps:
        return ranked.select(*inner, *[F.lit(0).cast("long").alias(c.name) for c in places]).withColumnsRenamed(dict(zip(inner, names, strict=True)))

    step_length, step_rank, step_first, step_offset = (np.array(x, np.int64) for x in zip(*steps, strict=True))
    step_key = (step_length << 42) + step_rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "rank"))
            step = np.searchsorted(step_key, (length << 42) + rank, "right") - 1
            columns = [batch.column(c) for c in inner]
            columns += [pa.array(step_first[step] + rank - step_rank[step]), pa.array(step_offset[step])]
            yield pa.RecordBatch.from_arrays(columns, [*inner, "sequence_id", "offset"])

    whole = ranked.join(offsets, ["size", "part"]).select(*inner, "size", (F.col("rank") + F.col("before")).alias("rank"))
    return whole.mapInArrow(place, T.StructType(fields + places)).withColumnsRenamed(dict(zip(inner, names, strict=True)))


def packing_report(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with the crc32 of its ids and its place; the ids themselves are neither written nor shuffled.

    Pieces are written, without their ids, before they are numbered: a task then has one Python worker, not two at a time.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pack_pieces(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
