"""Byte-level BPE: texts to token ids and back, by padded matrices of equally long pieces.

A text is cut into the matches of a pattern, and each match is encoded apart. A match that is a token itself has its
id. The bytes of the others are the rows of matrices, one per power of two of their lengths; every round finds each
row's leftmost pair of the smallest rank, puts the merged token in its place, and closes the gap. Ranks of pairs come
from an open-addressed hash table. Rows without a mergeable pair leave the matrix.

A round moves a whole row, so a row costs the square of its length. Matches beyond ``WIDEST`` bytes therefore take the
same merges in the same order from a heap of (rank, place).

Results of each case: a null text is an empty one, and an empty text has no ids; bytes that are no UTF-8 are read as
U+FFFD. A task works on a mebibyte of text at a time, or on one longer text; longer texts are cut into runs of matches.
Repeated rows stay repeated; all columns but the text are passed on, and one that is named like the result is replaced.
Null ids decode to null, ids outside of the vocabulary (and null ones inside a list) to U+FFFD. An empty table gives an
empty one.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardledger.llm.words import chunks, utf8

#: Bytes of the longest match that is merged in a matrix, and cells of a matrix.
WIDEST, CELLS = 512, 1 << 18
#: Matches that a task remembers before it starts anew, and matches of a run.
_REMEMBERED, _RUN = 1 << 18, 1 << 18
_NONE, _EMPTY = np.int32(2**31 - 1), np.int64(-1)
_REPLACEMENT = "�".encode()


class PairTable:
    """Ranks of token pairs by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(2 * len(rank)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        key = self._key(left, right)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, slot = key[rest], rank[rest], self._next(slot[rest])

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) + right

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_NONE`` where it doesn't merge; ids of -1 are padding."""
        key = self._key(left, right).ravel()
        slot = self._slot(key)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(open_):
            slot[open_] = self._next(slot[open_])
            found = self.keys[slot[open_]]
            open_ = open_[(found != key[open_]) & (found != _EMPTY)]
        return self.ranks[slot].reshape(left.shape)


class Vocabulary:
    """Tokens by rank; a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = dict(zip(self.ids.values(), self.ids.keys(), strict=True))
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        merges = [
            (self.ids[t[:i]], self.ids[t[i:]], rank)
            for t, rank in self.ids.items()
            for i in range(1, len(t))
            if t[:i] in self.ids and t[i:] in self.ids
        ]
        self.rank_of = PairTable(*np.array(merges, np.int32).reshape(-1, 3).T)
        size = max(self.tokens) + 1
        stored = [self.tokens.get(i, _REPLACEMENT) for i in range(size)] + [_REPLACEMENT]
        self.bytes = np.frombuffer(b"".join(stored), np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in stored])])

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all ids in a row."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, numbers of ids, ids
        whole = [(i, self.ids[p]) for i, p in enumerate(pieces) if p in self.ids]
        if whole:
            places, ids = np.array(whole, np.int64).T
            found.append((places, np.ones(len(places), np.int64), ids.astype(np.int32)))
        rest = [i for i, p in enumerate(pieces) if p not in self.ids]
        buckets: dict[int, list[int]] = {}
        for i in rest:
            buckets.setdefault(len(pieces[i] or b" ").bit_length() if len(pieces[i]) <= WIDEST else 0, []).append(i)
        for bits, members in buckets.items():
            step = max(1, CELLS >> bits) if bits else 1
            for at in range(0, len(members), step):
                part = members[at : at + step]
                if bits:
                    found.extend((np.array(part)[rows], n, ids) for rows, n, ids in self._matrix([pieces[i] for i in part]))
                else:
                    ids = self._long(pieces[part[0]])
                    found.append((np.array(part), np.array([len(ids)]), ids))
        count = np.zeros(len(pieces), np.int64)
        for places, n, _ in found:
            count[places] = n
        first = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(first[-1], np.int32)
        for places, n, ids in found:
            out[_ranges(first[places], n)] = ids
        return count, out

    def _matrix(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merges all rows of one matrix, a pair of each row a round; rows come out as they are finished."""
        size = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), size.max()), -1, np.int32)
        ids[np.arange(ids.shape[1]) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks, rows = self.rank_of(ids[:, :-1], ids[:, 1:]), np.arange(len(pieces))
        while len(rows):
            if not ranks.shape[1]:
                merging = np.zeros(len(rows), bool)
            else:
                at = ranks.argmin(axis=1)
                best = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
                merging = best != _NONE
            if not merging.all():
                done = ids[~merging]
                yield rows[~merging], (done >= 0).sum(axis=1), done[done >= 0]
                rows, ids, ranks = rows[merging], ids[merging], ranks[merging]
                if not len(rows):
                    return
                at, best = at[merging], best[merging]
            all_ = np.arange(len(rows))
            ids[all_, at] = best
            ids, ranks = _without(ids, at + 1), _without(ranks, at)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank_of(ids[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < ranks.shape[1])
            ranks[right, at[right]] = self.rank_of(best[right], ids[right, at[right] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges of one long piece, from a heap."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        rank = [*self.rank_of(ids[:-1], ids[1:]).tolist(), int(_NONE)]
        ids, left, right = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        none = int(_NONE)
        heap = [(r, i) for i, r in enumerate(rank) if r != none]
        heapq.heapify(heap)

        def ranked(i: int) -> None:
            j = right[i]
            rank[i] = self.ids.get(self.tokens[ids[i]] + self.tokens[ids[j]], none) if j < n else none
            if rank[i] != none:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = right[i]
            ids[i], ids[j], rank[j] = r, -1, none
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            ranked(i)
            if left[i] >= 0:
                ranked(left[i])
        out = np.array(ids, np.int32)
        return out[out >= 0]

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes each id has, and all bytes in a row."""
        ids = np.where((ids >= 0) & (ids < len(self.first) - 2), ids, len(self.first) - 2)
        count = self.first[ids + 1] - self.first[ids]
        return count, self.bytes[_ranges(self.first[ids], count)]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(count.sum())


def _without(cells: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Each row without one of its columns."""
    keep = np.ones(cells.shape, bool)
    keep[np.arange(len(cells)), column] = False
    return cells[keep].reshape(len(cells), cells.shape[1] - 1)


class Encoder:
    """Encodes texts; ids of matches seen before are looked up."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = _vocabulary(path), regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.first, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _matches(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each match, and all ids."""
        if len(self.places) > _REMEMBERED:
            self._forget()
        new = [m for m in dict.fromkeys(matches) if m not in self.places]
        if new:
            count, ids = self.vocabulary.pieces([m.encode() for m in new])
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        at = np.fromiter(map(self.places.__getitem__, matches), np.int64, len(matches))
        return self.count[at], self.ids[_ranges(self.first[at], self.count[at])]

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        if len(texts) == 1:
            matches = (m.group() for m in self.pattern.finditer(texts[0].decode("utf-8", "replace")))
            runs = [self._matches(run)[1] for run in iter(lambda: list(islice(matches, _RUN)), [])]
            ids = np.concatenate([np.empty(0, np.int32), *runs])
            return np.array([len(ids)]), ids
        found = [self.pattern.findall(t.decode("utf-8", "replace")) for t in texts]
        count, ids = self._matches([m for matches in found for m in matches])
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *map(len, found)])]
        return np.diff(ends), ids


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array, without: str) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in (name, without)]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), column], [*kept, name])


def _schema(df: DataFrame, name: str, kind: T.DataType, without: str) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in (name, without)]
    return T.StructType([*kept, T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The columns of ``docs`` but the text, and ``ids`` (array of int): its tokens by the ranks of the file ``path``.

    ``path`` is the place of the vocabulary on every machine; ``pattern`` cuts a text into the matches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            texts = utf8(batch.column(text))
            for start, end in chunks(texts):
                count, found = encoder.texts(texts[start:end])
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found, pa.int32()))
                yield _with_column(batch.slice(start, end - start), ids, column, text)

    return docs.mapInArrow(run, _schema(docs, ids, T.ArrayType(T.IntegerType()), text))


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns of ``tokens``, and ``out`` (binary): the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in batches:
            lists = batch.column(ids)
            sizes = np.array(lists.value_lengths().fill_null(0))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            start = 0
            while start < len(lists):
                end = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 20), "right")) - 1)
                part = lists.slice(start, end - start)
                count, data = vocabulary.decoded(np.array(part.flatten().fill_null(-1), np.int64))
                at = np.concatenate([[0], np.cumsum(count)])[ends[start : end + 1] - ends[start]].astype(np.int32)
                null = pa.array(~np.array(part.is_null())).buffers()[1] if part.null_count else None
                buffers = [null, pa.py_buffer(at), pa.py_buffer(data)]
                column = pa.Array.from_buffers(pa.binary(), end - start, buffers)
                yield _with_column(batch.slice(start, end - start), out, column, out)
                start = end

    return tokens.mapInArrow(run, _schema(tokens, out, T.BinaryType(), out))


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    found = decode(encode(docs.select("doc_id", "text"), path, pattern), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
