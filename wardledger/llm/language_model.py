"""Scores of texts under a hashed maximum-entropy language model, beside a smoothed unigram base.

Tokens are the lower-cased (A-Z) words between ASCII white space, then one end token. The model factors a token's
probability into that of its class and that of the token within its class. The ``SINGLES`` most frequent training
tokens are a class each; all others fall into ``SUFFIXES`` classes by their last two bytes, so that unknown words
have a class too. Classes are predicted by a softmax over hashed n-gram and skip features of the preceding tokens;
within a class the softmax has one free weight per word, whose optimum is the word's smoothed share of the class.

Training: all training texts are dealt by a hash of id and text to shares of about ``SHARE`` tokens, whose number
follows from the corpus and not from the cluster, and put in order of that hash. One task runs through each share and
takes gradient steps in sparse numpy batches from the common start; the changed weight rows go to the tasks that own the
rows, which average them by the evidence behind each. So the scores depend on the table alone, apart from the order of
sums, and a lost task repeats one share. Rows that agree in id and text are in one share. Counts cover all training
tokens. Tokens are counted by a 64-bit hash of the word; of equally frequent ones those of smaller hashes are singles.

Scoring: class probabilities come in sparse numpy batches. Tokens with at least one 2**20th of all occurrences,
hence at most 2**20 different ones, are looked up in a table given to all tasks; the rest are joined with the counts.

A null text is empty and has the end token only. Repeated rows are scored each for itself, whatever their ids. With
no training row all counts are 0 and the weights stay 0. An empty table gives an empty result. Texts are read whole,
in chunks; columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.llm.langid import remainder
from wardledger.llm.words import BLANKS, chunks, mixed, utf8, word_hashes
from wardledger.session import Workspace

SINGLES, SUFFIXES = 32, 32
CLASSES = SINGLES + SUFFIXES
BITS = 16
FEATURES = 6
HEAD = 1 << 20
SHARE = 1 << 23
SMOOTHING = 0.1
END_HASH = np.uint64(0x5DEECE66D1CE4E5B)
#: Past gradients that every row starts with, so that a rare feature's first steps are small.
START_SQUARE = 10.0
_BATCH = 4096
_FEW = 32
_CHUNK = 1 << 18


def _suffix_classes() -> np.ndarray:
    """Class of the last two bytes as a number; a single byte stands behind 0."""
    pairs = [zlib.crc32(bytes([a, b])) % SUFFIXES for a in range(256) for b in range(256)]
    pairs[:256] = [zlib.crc32(bytes([b])) % SUFFIXES for b in range(256)]
    return np.array(pairs, np.uint8)


_SUFFIX = _suffix_classes()


class Tokens(NamedTuple):
    """Tokens of several texts in order: their hashes, suffix classes, place in their text, and text."""

    hashes: np.ndarray
    suffix: np.ndarray
    place: np.ndarray
    owner: np.ndarray


class ClassModel(NamedTuple):
    """``singles``: sorted hashes of the tokens that are a class each. ``weights``: a row of class weights a feature."""

    singles: np.ndarray
    weights: np.ndarray


def tokens_of(texts: list[bytes]) -> Tokens:
    hashes, bounds = word_hashes(texts, BLANKS)
    data = np.frombuffer(b" " + b" ".join(texts).translate(BLANKS) + b" ", np.uint8)
    ends = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32))
    before = data[ends - 1] if len(ends) else data[:0]
    suffix = _SUFFIX[np.where(before == 32, 0, before).astype(np.int64) * 256 + data[ends]]
    counts = np.diff(bounds)
    at = np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), counts)  # leaves room for the ends
    total = len(hashes) + len(texts)
    all_hashes, all_suffix = np.full(total, END_HASH), np.zeros(total, np.uint8)
    all_hashes[at], all_suffix[at] = hashes, suffix
    owner = np.repeat(np.arange(len(texts)), counts + 1)
    first = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]) if len(texts) else np.empty(0, np.int64)
    return Tokens(all_hashes, all_suffix, np.arange(total) - first[owner], owner)


def classes_of(tokens: Tokens, singles: np.ndarray) -> np.ndarray:
    out = SINGLES + tokens.suffix.astype(np.int64)
    if len(singles):
        slot = np.minimum(np.searchsorted(singles, tokens.hashes), len(singles) - 1)
        out = np.where(singles[slot] == tokens.hashes, slot, out)
    return out


def features_of(tokens: Tokens, classes: np.ndarray) -> np.ndarray:
    """Rows of hashed features for each token: bias, the token before, the two before, one and two places further
    back alone (skips), and the three classes before."""
    n = len(tokens.hashes)
    rows = np.zeros((FEATURES, n), np.int64)

    def back(values: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[k:] = values[: n - k]
        out[tokens.place < k] = 0  # before the text's start
        return out

    one, two, three = (back(tokens.hashes, k) for k in (1, 2, 3))
    c = classes.astype(np.uint64) + np.uint64(1)
    c1, c2, c3 = (back(c, k) for k in (1, 2, 3))
    trigram = (c1 * np.uint64(CLASSES + 1) + c2) * np.uint64(CLASSES + 1) + c3
    for i, value in enumerate((one, one + two * np.uint64(3), two, three, trigram), 1):
        rows[i] = (mixed(value + np.uint64(i << 40)) >> np.uint64(64 - BITS)).astype(np.int64)
    return rows


def class_logits(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unnormalized logarithms, a row for each token, the largest 0."""
    z = weights.take(rows[1], axis=0)
    more = np.empty_like(z)
    for r in rows[2:]:
        z += np.take(weights, r, axis=0, out=more, mode="clip")
    z += weights[rows[0, :1]]  # the bias is one row
    z -= z.max(axis=1, keepdims=True)
    return z


def class_probabilities(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = class_logits(rows, weights)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def class_scores(tokens: Tokens, model: ClassModel) -> np.ndarray:
    """log10 of the probability of each token's class."""
    classes = classes_of(tokens, model.singles)
    rows = features_of(tokens, classes)
    out = np.empty(len(classes))
    for a in range(0, len(classes), _BATCH):
        b = min(a + _BATCH, len(classes))
        z = class_logits(rows[:, a:b], model.weights)
        out[a:b] = z[np.arange(b - a), classes[a:b]]
        out[a:b] -= np.log(np.exp(z, out=z).sum(axis=1))
    return out / np.log(10)


def group_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each group's rows of ``values``: those named by ``sizes`` places of ``order`` from ``first`` on.

    Most groups are small, so the k-th rows of all of them are added at once; large ones are summed one by one.
    """
    out = values.take(order[first], axis=0)
    rest = np.flatnonzero((sizes > 1) & (sizes <= _FEW))
    for k in range(1, _FEW):
        if not len(rest):
            break
        out[rest] += values.take(order[first[rest] + k], axis=0)
        rest = rest[sizes[rest] > k + 1]
    for g in np.flatnonzero(sizes > _FEW):
        out[g] = values.take(order[first[g] : first[g] + sizes[g]], axis=0).sum(axis=0)
    return out


class Trainer:
    """Gradient steps on one task's share of the texts; each row's step shrinks with its past gradients."""

    def __init__(self, singles: np.ndarray, rate: float):
        self.singles, self.rate = singles, rate
        self.weights = np.zeros((1 << BITS, CLASSES), np.float32)
        self.squares = np.full(1 << BITS, START_SQUARE, np.float32)
        self.evidence = np.zeros(1 << BITS, np.int64)

    def learn(self, texts: list[bytes]) -> None:
        tokens = tokens_of(texts)
        classes = classes_of(tokens, self.singles)
        rows = features_of(tokens, classes)
        for a in range(0, len(classes), _BATCH):
            part, answer = rows[:, a : a + _BATCH], classes[a : a + _BATCH]
            error = class_probabilities(part, self.weights)
            error[np.arange(len(answer)), answer] -= 1
            self._step(part[0, :1], error.sum(axis=0, keepdims=True), np.array([len(answer)]))
            features = part[1:].ravel()
            order = np.argsort(features.astype(np.uint16), kind="stable")
            found = features[order]
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            sizes = np.diff(np.append(first, len(found)))
            self._step(found[first], group_sums(error, order % len(answer), first, sizes), sizes)

    def _step(self, rows: np.ndarray, slope: np.ndarray, evidence: np.ndarray) -> None:
        squares = self.squares[rows] + np.einsum("ij,ij->i", slope, slope) / CLASSES
        self.squares[rows] = squares
        slope *= (-self.rate / np.sqrt(squares))[:, None]
        slope += self.weights.take(rows, axis=0)
        self.weights[rows] = slope
        self.evidence[rows] += evidence


def _training(docs: DataFrame, id_column: str, text_column: str, folds: int) -> DataFrame:
    text = F.col(text_column)
    kept = docs.filter(remainder(F.col(id_column), folds) != 0)
    return kept.select(text.alias("text"), F.xxhash64(F.col(id_column).cast("string"), text).alias("place"))


def token_counts(texts: DataFrame) -> DataFrame:
    """``token`` (hash), ``suffix`` class and count ``c`` of all tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = utf8(batch.column(0))
            for a, b in chunks(rows, 1 << 22):
                parts = [tokens_of(rows[x + a : y + a]) for x, y in chunks(rows[a:b])]
                hashes, suffix = (np.concatenate([getattr(p, f) for p in parts]) for f in ("hashes", "suffix"))
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                columns = [pa.array(found.view(np.int64)), pa.array(suffix[first].astype(np.int32)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "suffix", "c"])

    counted = texts.mapInArrow(count, "token long, suffix int, c long")
    return counted.groupBy("token").agg(F.first("suffix").alias("suffix"), F.sum("c").alias("c"))


def train_classes(texts: DataFrame, singles: np.ndarray, shares: int, rate: float = 0.4) -> np.ndarray:
    """The weights, averaged over the shares of ``texts`` (``text``, ``place``) by evidence."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(singles, rate)
        for batch in batches:
            rows = utf8(batch.column(0))
            for a, b in chunks(rows, _CHUNK):
                trainer.learn(rows[a:b])
        touched = np.flatnonzero(trainer.evidence)
        for part in np.array_split(touched, 1 + len(touched) // 4096):
            columns = [pa.array(part), pa.array(trainer.evidence[part]), pa.array([w.tobytes() for w in trainer.weights[part]], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "evidence", "weights"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, evidence = np.zeros((1 << BITS, CLASSES)), np.zeros(1 << BITS)
        for batch in batches:
            row, seen = (batch.column(c).to_numpy() for c in ("row", "evidence"))
            weights = np.frombuffer(b"".join(batch.column("weights").to_pylist()), np.float32).reshape(-1, CLASSES)
            np.add.at(total, row, weights * seen[:, None])
            np.add.at(evidence, row, seen)
        found = np.flatnonzero(evidence)
        mean = (total[found] / evidence[found][:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([m.tobytes() for m in mean], pa.binary())], ["row", "weights"])

    dealt = texts.repartition(shares, "place").sortWithinPartitions("place").select("text")
    # One trainer a share at most, also where a session deals rows to more tasks: each sends up to a whole table of weights.
    changes = dealt.coalesce(shares).mapInArrow(learn, "row long, evidence long, weights binary")
    owned = changes.repartition(min(shares, 64), "row").mapInArrow(average, "row long, weights binary").toArrow()
    weights = np.zeros((1 << BITS, CLASSES), np.float32)
    if owned.num_rows:
        data = b"".join(owned.column("weights").to_pylist())
        weights[owned.column("row").to_numpy()] = np.frombuffer(data, np.float32).reshape(-1, CLASSES)
    return weights


class Head(NamedTuple):
    """Frequent tokens by sorted hash with their log10 probabilities; for the others those of count 0."""

    hashes: np.ndarray
    base: np.ndarray
    inner: np.ndarray


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 10) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows of fold 0 of ``folds`` are held out of all training.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    training = _training(docs, id_column, text_column, folds)
    counts = space.keep(token_counts(training.select("text")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    norm = total["n"] + SMOOTHING * (total["v"] + 1)
    top = counts.orderBy(F.desc("c"), "token").limit(SINGLES).toArrow()
    singles = np.sort(top.column("token").to_numpy().view(np.uint64))
    weights = train_classes(training, singles, 1 + total["n"] // SHARE)
    model = spark.sparkContext.broadcast(ClassModel(singles, weights))

    is_single = F.col("token").isin(singles.view(np.int64).tolist())
    by_class = counts.filter(~is_single).groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    inner_norm = np.full(SUFFIXES, SMOOTHING)
    for r in by_class:
        inner_norm[r["suffix"]] = r["c"] + SMOOTHING * (r["v"] + 1)
    frequent = counts.filter(F.col("c") * HEAD >= total["n"]).toArrow()
    order = np.argsort(frequent.column("token").to_numpy().view(np.uint64))
    hashes, c = (frequent.column(k).to_numpy()[order] for k in ("token", "c"))
    suffix = frequent.column("suffix").to_numpy()[order]
    inner = np.where(np.isin(hashes.view(np.uint64), singles), 0.0, np.log10((c + SMOOTHING) / inner_norm[suffix]))
    head = spark.sparkContext.broadcast(Head(hashes.view(np.uint64), np.log10((c + SMOOTHING) / norm), inner))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, m = head.value, model.value
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts, _CHUNK):
                yield _scored(batch.slice(a, b - a), tokens_of(texts[a:b]), h, m)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema[id_column].dataType.simpleString()
    rest = "array<struct<token:long,suffix:int,n:int>>"
    schema = f"row long, id {kind}, n_tokens long, n_known long, base double, score double, rest {rest}"
    scored = space.keep(rows.mapInArrow(score, schema), "scored")
    tail = scored.select("row", F.inline("rest")).join(counts.select("token", "c"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    norms = F.array(*[F.lit(float(x)) for x in inner_norm])
    share = (c + SMOOTHING) / F.element_at(norms, F.col("suffix") + 1)
    tail = tail.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10((c + SMOOTHING) / norm)).alias("tail_base"),
        F.sum(F.col("n") * F.log10(share)).alias("tail_score"),
    )
    found = scored.drop("rest").join(tail, "row", "left")

    def plus(name: str, more: str) -> Column:
        return (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)

    return found.select(
        F.col("id").alias(id_column),
        (remainder(F.col("id"), folds) == 0).alias("held_out"),
        "n_tokens",
        plus("n_known", "tail_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        plus("base", "tail_base").alias("base_score"),
        plus("score", "tail_score"),
    )


def _scored(batch: pa.RecordBatch, tokens: Tokens, head: Head, model: ClassModel) -> pa.RecordBatch:
    """The sums over classes and frequent tokens of each text, and its other tokens with their counts."""
    n = batch.num_rows
    slot = np.minimum(np.searchsorted(head.hashes, tokens.hashes), max(len(head.hashes) - 1, 0))
    frequent = head.hashes[slot] == tokens.hashes if len(head.hashes) else np.zeros(len(slot), bool)
    per_text = lambda owner, values=None: np.bincount(owner, values, n)
    owner, slot = tokens.owner[frequent], slot[frequent]
    score = per_text(tokens.owner, class_scores(tokens, model))
    if len(head.hashes):
        score = score + per_text(owner, head.inner[slot])
        base = per_text(owner, head.base[slot])
    else:
        base = np.zeros(n)
    other = np.flatnonzero(~frequent)
    order = other[np.lexsort((tokens.hashes[other], tokens.owner[other]))]
    owner, hashes = tokens.owner[order], tokens.hashes[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))) if len(order) else order
    repeats = np.diff(np.append(first, len(order))).astype(np.int32)
    rest = pa.StructArray.from_arrays(
        [pa.array(hashes[first].view(np.int64)), pa.array(tokens.suffix[order][first].astype(np.int32)), pa.array(repeats)],
        ["token", "suffix", "n"],
    )
    bounds = np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("row"),
            batch.column("id"),
            pa.array(per_text(tokens.owner)),
            pa.array(per_text(tokens.owner[frequent])),
            pa.array(base.astype(float)),
            pa.array(score.astype(float)),
            pa.ListArray.from_arrays(pa.array(bounds), rest),
        ],
        ["row", "id", "n_tokens", "n_known", "base", "score", "rest"],
    )


def score_report(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
