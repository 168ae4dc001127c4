"""Words of whole texts as arrays of 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def _table(separators: bytes) -> bytes:
    return bytes.maketrans(_UPPER + separators, _LOWER + b" " * len(separators))


#: Lower-cases A-Z and turns what separates words into a blank: white space, or all ASCII but letters and digits.
BLANKS = _table(bytes(range(9, 14)))
NON_ALPHANUMERIC = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers don't vanish modulo 2**64
_STEP = 1 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin and end (len(texts) + 1 bounds)."""
    joined = b" ".join(texts).translate(table) + b" "
    data = np.frombuffer(joined, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = len(data) if at + _STEP >= len(data) else joined.find(b" ", at + _STEP) + 1
        found, places = _hash_piece(data[at:end])
        hashes.append(found)
        starts.append(places + at)
        at = end
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.searchsorted(starts, begins)


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the words of one piece, which ends with a blank, and where the words start."""
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    terms = (data[inside[1:-1]].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mixed(np.add.reduceat(terms, first)), starts


def runs_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = mixed(total + words[k : k + count] * np.uint64(2 * k + 3))
    return total
