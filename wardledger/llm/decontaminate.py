"""Benchmark passages in documents: a prefix-filtered join of word windows with exact verification.

A window is ``n`` consecutive words of a benchmark item, or the whole item where it has fewer. A document contains
a window where the same words stand in the same order. The join runs over words ordered by their rarity in the
whole document table: containment needs all of a window's words, so the necessary prefix is its rarest word alone,
and only document words that are some window's prefix word make candidates. The prefix word's place in the window
fixes where the window would begin, which must leave room for it in the document (positional and length bounds);
the next rare word must be in its place; then all words are compared, at last byte by byte.

The windows are given to all tasks in blocks, one pass over the documents per block, so memory does not grow with the
benchmark; a long item is cut into overlapping pieces that keep all of its windows, and different pieces fill the
blocks in turn: those of a block begin within ``block_bytes`` of benchmark text, so that only the last one reaches
beyond. Document texts are never shuffled.

Null and empty documents have no words and no hits; null and empty items have no windows. Repeated items count
once per id; windows of an item without an id mark words but name no item. Repeated documents repeat their result.
An empty table on either side gives no hits. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardledger.llm.words import NON_ALPHANUMERIC, chunks, utf8, word_hashes
from wardledger.session import Workspace

_PIECE_WORDS = 4096
_SLOTS = 64


class Windows(NamedTuple):
    """Windows of one block, grouped by prefix word: those of ``anchors[i]`` are ``first[i]:first[i + 1]``."""

    n: int
    anchors: np.ndarray  # sorted hashes of prefix words
    first: np.ndarray
    offset: np.ndarray  # place of the prefix word in the window
    second: np.ndarray  # place of the second rarest word
    length: np.ndarray
    hashes: np.ndarray  # word hashes, n to a window, padded with 0
    words: list[list[bytes]]
    item: list[str | None]


class Hits(NamedTuple):
    n_words: int
    spans: list[tuple[int, int]]
    items: list[str]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NON_ALPHANUMERIC).split()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans in which overlapping and touching ones are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_windows(items: list[tuple[str | None, bytes]], n: int) -> list[tuple[str | None, list[bytes]]]:
    """All distinct windows of items, each with its item."""
    found = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - n + 1) if words else 0):
            found[item, tuple(words[i : i + n])] = None
    return [(item, list(words)) for item, words in found]


def index_windows(windows: list[tuple[str | None, list[bytes]]], counts: dict[int, int], n: int) -> Windows:
    """Finds each window's two rarest words by the counts of word hashes and groups windows by the rarest."""
    vocabulary = sorted({x for _, words in windows for x in words})
    known = dict(zip(vocabulary, word_hashes([b" ".join(vocabulary)], NON_ALPHANUMERIC)[0], strict=True))
    rows = []
    for item, words in windows:
        hashes = [known[x] for x in words]
        by_rarity = sorted(range(len(words)), key=lambda i: (counts.get(int(hashes[i]), 0), int(hashes[i]), i))
        rows.append((int(hashes[by_rarity[0]]), by_rarity[0], by_rarity[1 % len(words)], hashes, words, item))
    rows.sort(key=lambda r: (r[0], r[1], r[4], r[5] or ""))
    anchors, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
    matrix = np.zeros((len(rows), n), np.uint64)
    for k, r in enumerate(rows):
        matrix[k, : len(r[3])] = r[3]
    return Windows(
        n, anchors, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]),
        np.array([len(r[4]) for r in rows]), matrix, [r[4] for r in rows], [r[5] for r in rows],
    )


def find_windows(texts: list[bytes], w: Windows) -> list[Hits]:
    """What each text contains of the windows."""
    hashes, bounds = word_hashes(texts, NON_ALPHANUMERIC)
    found: list[Hits] = [Hits(int(b - a), [], []) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    if not len(w.anchors) or not len(hashes):
        return found
    slot = np.minimum(np.searchsorted(w.anchors, hashes), len(w.anchors) - 1)
    at = np.flatnonzero(w.anchors[slot] == hashes)
    slot = slot[at]
    fan = w.first[slot + 1] - w.first[slot]
    place = np.repeat(at, fan)
    window = np.repeat(w.first[slot] - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan) + np.arange(fan.sum())
    owner = np.searchsorted(bounds, place, "right") - 1
    start = place - w.offset[window]
    good = (start >= bounds[owner]) & (start + w.length[window] <= bounds[owner + 1])
    start, window, owner = start[good], window[good], owner[good]
    good = hashes[start + w.second[window]] == w.hashes[window, w.second[window]]
    start, window, owner = start[good], window[good], owner[good]
    for k in range(w.n):
        inside = k < w.length[window]
        good = ~inside | (hashes[np.where(inside, start + k, 0)] == w.hashes[window, k])
        start, window, owner = start[good], window[good], owner[good]
    for d in np.unique(owner):
        mine = owner == d
        words = words_of(texts[d])
        exact = [
            (int(s), int(x))
            for s, x in zip(start[mine] - bounds[d], window[mine], strict=True)
            if words[s : s + w.length[x]] == w.words[x]
        ]
        items = sorted({w.item[x] for _, x in exact if w.item[x] is not None})
        found[d] = Hits(len(words), merged([(s, s + int(w.length[x])) for s, x in exact]), items)
    return found


def _pieces(benchmark: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """Items as pieces of bounded length that overlap by ``n - 1`` words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = words_of(text)
                parts = [
                    b" ".join(words[i : i + _PIECE_WORDS + n - 1]) for i in range(0, max(len(words) - n + 1, 1), _PIECE_WORDS)
                ]
                parts = [p for p in parts if p]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.binary())], ["item", "words"]
                )

    rows = benchmark.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    return rows.mapInArrow(cut, "item string, words binary")


def _dealt(pieces: DataFrame, block_bytes: int, space: Workspace) -> tuple[DataFrame, int]:
    """Different pieces with the ``block`` in which they begin when laid end to end, and the number of blocks."""
    size = F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64
    slot = F.pmod(F.xxhash64("item", "words"), F.lit(_SLOTS)).cast("int")
    once = space.keep(pieces.distinct().withColumn("size", size.cast("long")).withColumn("slot", slot), "once")
    sums = {r["slot"]: r["n"] for r in once.groupBy("slot").agg(F.sum("size").alias("n")).collect()}
    *offsets, total = accumulate((sums.get(k, 0) for k in range(_SLOTS)), initial=0)
    before = Window.partitionBy("slot").orderBy("item", "words").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("slot") + 1)
    begin = begin + F.coalesce(F.sum("size").over(before), F.lit(0))
    block = F.floor(begin / F.lit(block_bytes)).cast("long")
    return space.keep(once.select("item", "words", block.alias("block")), "pieces"), 1 + max(total - 1, 0) // block_bytes


def _word_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often the words of a block stand in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in chunks(texts):
                hashes, _ = word_hashes(texts[a:b], NON_ALPHANUMERIC)
                slot = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                total += np.bincount(slot[vocabulary[slot] == hashes], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["word", "n"])

    if not len(vocabulary):
        return {}
    rows = docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r["word"]]): r["n"] for r in rows}


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    block_bytes: int = 8 << 20,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: its id (or the columns ``carry``), and what it holds of the benchmark.

    ``n_words``, ``spans`` (ranges of words inside windows, end exclusive) and ``items`` (sorted ids as text).
    """
    spark: SparkSession = docs.sparkSession
    space = Workspace(spark)
    pieces, blocks = _dealt(_pieces(benchmark, item_column, text_column, n), block_bytes, space)
    carry = carry or (id_column,)
    carried = [f"c{i}" for i in range(len(carry))]
    texts = docs.select(F.col(text_column).alias("text"), *[F.col(c).alias(a) for c, a in zip(carry, carried, strict=True)])
    if blocks > 1:
        texts = texts.withColumn("row", F.monotonically_increasing_id())
    found = []
    for block in range(blocks):
        rows = pieces.filter(F.col("block") == block).select("item", "words").collect()
        windows = item_windows([(r["item"], bytes(r["words"])) for r in rows], n)
        words = {x for _, found_words in windows for x in found_words}
        vocabulary = np.unique(word_hashes([b" ".join(words)], NON_ALPHANUMERIC)[0])
        index = index_windows(windows, _word_counts(texts.select("text"), vocabulary), n)
        found.append(_marked(texts, index))
    space.close()
    if blocks > 1:
        one = found[0]
        for more in found[1:]:
            one = one.unionByName(more)
        # A row has as many parts as there are blocks.
        one = one.groupBy("row").agg(
            *[F.first(c).alias(c) for c in carried],
            F.first("n_words").alias("n_words"),
            _union_of(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        found = [one.drop("row")]
    return found[0].withColumnsRenamed(dict(zip(carried, carry, strict=True)))


def _union_of(spans):
    """Sorted spans merged where they overlap or touch."""
    kind = "array<struct<start:long,end:long>>"

    def add(done, span):
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(
            (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def _marked(texts: DataFrame, index: Windows) -> DataFrame:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kept = [c for c in texts.columns if c != "text"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = utf8(batch.column("text"))
            hits = [h for a, b in chunks(rows) for h in find_windows(rows[a:b], index)]
            columns = {c: batch.column(c) for c in kept} | {
                "n_words": pa.array([h.n_words for h in hits], pa.int64()),
                "spans": pa.array([[{"start": s, "end": e} for s, e in h.spans] for h in hits], pa.list_(span)),
                "items": pa.array([h.items for h in hits], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    spans = T._parse_datatype_string("array<struct<start:long,end:long>>")
    fields = [
        *(texts.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("spans", spans),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    return texts.mapInArrow(mark, T.StructType(fields))


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds ``n_hit`` (words inside windows) and ``contaminated``: a twentieth of the words is hit, one at least."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.withColumn("n_hit", hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words and items of each document."""
    return with_verdict(find_contamination(docs, benchmark)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
