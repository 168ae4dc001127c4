"""Language of texts: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

A text is the mean of the embeddings of its subwords, which are the byte n-grams within its words (with the
blanks at their borders) hashed into ``2**BITS`` rows; a linear softmax of the mean gives the languages'
probabilities. Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows: about ``rows_per_language`` rows of each language, those with the smallest hashes. A fifth of the
sample is held back to fit the softmax's temperature.

Rejection: the softmax has one more class, for texts of no learned language. Its rows are made from the sample, one of
each text, of the same length: letters drawn anew from the same or from another script, letters dealt to other places,
or letters exchanged for others, vowels for vowels, as in a language that was not learned. A text whose calibrated probability of that class is above
``reject_above`` is rejected. Its ``score`` is the probability of the language named, which is the likeliest learned one.

Nothing but the text enters a prediction. A null text, and one without a letter, is ``und`` with score 0 and
rejected; so is every text where no labelled row was given. Of languages that are equally likely the first by name is given. Rows are independent, so repeated rows repeat their
prediction; texts are read whole, in chunks. Columns other than those named are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardledger.llm.words import chunks, utf8

UNKNOWN = "und"
BITS = 15
ORDERS = (2, 3, 4)

# First code points of Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari, Thai, kana, Han and Hangul letters.
_SCRIPTS = (0x391, 0x410, 0x531, 0x5D0, 0x620, 0x904, 0xE01, 0x3041, 0x4E00, 0xAC00)

_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_OTHERS = bytes(b for b in range(128) if b not in _LETTERS)
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _OTHERS, bytes(range(97, 123)) + b" " * len(_OTHERS))


class Model(NamedTuple):
    """``logits`` of a text: the mean of ``scores`` over its subwords, plus ``bias``, divided by ``temperature``.

    The last column of ``scores`` is the class of texts in none of the ``languages``.
    """

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_above: float


def subwords(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashed n-grams of all texts and the index of the text of each."""
    data = np.frombuffer(b" " + b" ".join(texts).translate(_TABLE) + b" ", np.uint8)
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    for n in ORDERS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        good = (data[:count] != 32) | (data[n - 1 :] != 32)
        for k in range(1, n - 1):
            good &= data[k : k + count] != 32
        at = np.flatnonzero(good)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + data[at + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield (h >> np.uint32(32 - BITS)).astype(np.int32), np.searchsorted(begins, at + 1, "right") - 1


def has_letter(text: bytes) -> bool:
    if text.translate(None, _OTHERS).isascii():
        return bool(text.translate(None, _OTHERS))
    return text.upper() != text.lower() or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def foreign(text: str, seed: int) -> str:
    """A text of the same shape that is in no language: other letters, letters in other places, or a cipher."""
    random = np.random.default_rng(seed & 0xFFFFFFFF)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).copy()
    found, place = np.unique(codes, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in found], bool)
    at = np.flatnonzero(letters[place])
    kind = seed % 4
    if kind == 0:
        codes[at] = random.integers(97, 123, len(at)) if (found[letters] < 0x250).all() else random.choice(found[letters], len(at))
    elif kind == 1:
        codes[at] = random.permutation(codes[at])
    elif kind == 2:
        first = random.choice(_SCRIPTS)
        codes[at] = random.choice([c for c in range(first, first + 80) if chr(c).isalpha()], len(at))
    else:
        alphabet = np.union1d(found[letters], np.arange(97, 123)) if (found[letters] < 0x250).all() else found[letters]
        vowel = np.array([unicodedata.normalize("NFD", chr(c))[0] in "aeiouy" for c in alphabet], bool)
        cipher = alphabet.copy()
        for group in (vowel, ~vowel):
            cipher[group] = random.permutation(alphabet[group])
        codes[at] = cipher[np.searchsorted(alphabet, codes[at])]
    return codes.tobytes().decode("utf-32-le", "replace")


def log_probabilities(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of each text, its calibrated probability, and whether the text is rejected."""
    width = model.scores.shape[1]
    total, counts = np.zeros((len(texts), width)), np.zeros(len(texts))
    for hashed, owner in subwords(texts):
        counts += np.bincount(owner, minlength=len(texts))
        for k in range(width):
            total[:, k] += np.bincount(owner, model.scores[hashed, k], len(texts))
    logits = total / np.maximum(counts, 1)[:, None] + model.bias
    p = np.exp(log_probabilities(logits / model.temperature))
    known = np.array([has_letter(t) for t in texts], bool)
    best = p[:, :-1].argmax(axis=1)
    return (
        [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
        np.where(known, p[np.arange(len(texts)), best], 0.0),
        ~known | (p[:, -1] > model.reject_above),
    )


def _shares(times: np.ndarray) -> np.ndarray:
    return (times / times.sum()).astype(np.float32)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: list[str | None],
    dim: int = 16,
    steps_per_language: int = 2_500,
    reject_above: float = 0.9,
) -> Model:
    """Fits a model to texts given as (subword hashes, how often each occurs), None labelling those of no language.

    Each language gets about ``steps_per_language`` steps, however many languages there are, and as many steps are taken
    on texts of none; every fifth row calibrates.
    """
    languages = sorted({x for x in labels if x is not None})
    number = {x: i for i, x in enumerate([*languages, None])}
    answer = np.array([number[x] for x in labels])
    width = len(number)
    random = np.random.default_rng(7)
    embeddings = random.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, width), np.float32), np.zeros(width, np.float32)
    squares, w_squares, b_squares = np.full(1 << BITS, 1e-8, np.float32), np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    order = np.arange(len(rows))
    fitted = order[order % 5 != 4]
    own = sum(x is not None for x in labels) / len(labels)
    epochs = max(1, round(steps_per_language * len(languages) / max(own * len(fitted), 1)))
    for epoch in range(epochs):
        rate = 0.1 * (1 - epoch / epochs)
        for i in random.permutation(fitted):
            hashed, share = rows[i][0], _shares(rows[i][1])
            mean = share @ embeddings[hashed]
            error = np.exp(log_probabilities((mean @ weights + bias)[None])[0])
            error[answer[i]] -= 1
            back = weights @ error
            slope = np.outer(mean, error)
            w_squares += slope**2
            b_squares += error**2
            weights -= rate * slope / np.sqrt(w_squares)
            bias -= rate * error / np.sqrt(b_squares)
            squares[hashed] += share**2 * (back @ back)
            embeddings[hashed] -= (rate * share / np.sqrt(squares[hashed]))[:, None] * back
    scores = embeddings @ weights
    held = order[order % 5 == 4] if len(rows) >= 50 else order
    logits = np.array([_shares(rows[i][1]) @ scores[rows[i][0]] for i in held]) + bias
    # Targets a little below 1 (Platt): a perfect held-back part would ask for ever sharper scores.
    target = np.full((len(held), width), 1 / (len(held) + 2) / max(width - 1, 1))
    target[np.arange(len(held)), answer[held]] = (len(held) + 1) / (len(held) + 2)
    grid = np.geomspace(0.05, 20, 120)
    loss = [-(target * log_probabilities(logits / t)).sum(axis=1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    return Model(languages, scores, bias, temperature, reject_above)


def _sampled(rows: DataFrame, rows_per_language: int) -> DataFrame:
    """About ``rows_per_language`` rows of each language, all of smaller ones: those with the smallest hashes.

    The share follows from the language's number of different rows, so none are ranked; of equal rows one is taken.
    """
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("count")).collect()  # one row a language
    span = 2.0**64
    limits = {r["lang"]: min(2.0**63, -(2.0**63) + span * rows_per_language / r["count"]) for r in counts}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")]
    return rows.filter(F.col("order").cast("double") <= limit).dropDuplicates(["order"])


def fit(
    labelled: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    rows_per_language: int = 800,
) -> Model | None:
    """A model from labelled rows; those without a language or a letter are left out. None without any."""
    rows = labelled.select(
        F.xxhash64(F.col(id_column).cast("string"), F.col(text_column)).alias("order"),
        F.col(lang_column).cast("string").alias("lang"),
        F.col(text_column).alias("text"),
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, texts = batch.column("order").to_pylist(), utf8(batch.column("text"))
            others = [foreign(t.decode("utf-8", "replace"), i).encode("utf-8", "replace") for t, i in zip(texts, order, strict=True)]
            hashes, times = [], []
            for text in [*texts, *others]:
                found, counts = np.unique(np.concatenate([h for h, _ in subwords([text])]), return_counts=True)
                hashes.append(found.astype(np.uint16).tobytes())
                times.append(counts.astype(np.min_scalar_type(counts.max(initial=1))).tobytes())
            languages = [*batch.column("lang").to_pylist(), *[None] * len(others)]
            columns = [pa.array(order * 2), pa.array(languages, pa.string()), pa.array(hashes, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["order", "lang", "hashes", "times"])

    if rows.isEmpty():
        return None
    sample = _sampled(rows, rows_per_language).select("order", "lang", "text")
    found = sample.mapInArrow(features, "order long, lang string, hashes binary, times binary").collect()
    found.sort(key=lambda r: (r["order"], r["lang"] or "", bytes(r["hashes"])))
    pairs = []
    for r in found:
        hashes = np.frombuffer(r["hashes"], np.uint16)
        pairs.append((hashes, np.frombuffer(r["times"], f"u{len(r['times']) // max(len(hashes), 1) or 1}")))
    return train(pairs, [r["lang"] for r in found])


def detect_language(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``lang_pred``, ``score`` and ``rejected``."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            languages, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for start, end in chunks(texts) if model else ():
                languages[start:end], scores[start:end], rejected[start:end] = predict(model, texts[start:end])
            columns = [batch.column(0), pa.array(languages, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "rejected"])

    fields = [("id", docs.schema[id_column].dataType), ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(label, schema).withColumnRenamed("id", id_column)


def identified(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(text_column))
            kept = np.zeros(len(texts), bool)
            for start, end in chunks(texts) if model else ():
                kept[start:end] = ~predict(model, texts[start:end])[2]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)


def remainder(column: Column, divisor: int) -> Column:
    """The row's fold: crc32 of the id as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % divisor


def language_report(docs: DataFrame) -> DataFrame:
    """Learns from the documents of folds 0 and 2 of 3 and predicts all of them."""
    fold = remainder(F.col("doc_id"), 3)
    model = fit(docs.filter(fold != 1))
    return detect_language(docs, model).select(
        "doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "rejected"
    )
