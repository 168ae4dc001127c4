import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardledger.llm.packing import best_fit, pack_pieces, packing_report, token_pieces
from wardledger.llm.queries import tokenizer
from wardledger.llm.word_encoder import RunTable, WordEncoder


@pytest.fixture(scope="module")
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


@settings(max_examples=80, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("aBé ß'sTM\n\t\x00\x0b\x1c  <|endoftext|>1,.Σİ́kK"), max_size=60))
def test_words_give_the_ids_of_the_whole_text(plain_tokenizer, text):
    encoder = WordEncoder.load(tokenizer())
    got = np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist()
    assert got == plain_tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(words=st.lists(st.text(alphabet=st.sampled_from("aBÉßeXĲİǅ.,;'#|-<>\u0301\u0130ſKk1ά"), min_size=1, max_size=8), max_size=6))
def test_words_of_letters_and_punctuation(plain_tokenizer, words):
    encoder = WordEncoder.load(tokenizer())
    assert encoder.splits
    text = " ".join(words)
    got = np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist()
    assert got == plain_tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(plain_tokenizer, words):
    encoder = WordEncoder(tokenizer(), most=20)
    texts = [" ".join(words(50, seed=i)) for i in range(5)]
    for text, got in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids


def test_report(docs, words, plain_tokenizer):
    rows = [(i, " ".join(words(random.Random(i).randrange(1, 900), seed=i))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " ".join(words(30_000, seed=3))), (103, "a"), (103, "a"), (None, "b")]
    found = packing_report(docs(*rows), tokenizer()).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    expected = Counter()
    for i, text in rows:
        ids = plain_tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            expected[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert got == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in found)
    assert len(sequences) <= -(-total // 2048) + 1


def test_pieces_carry_their_ids(docs):
    (row,) = token_pieces(docs((1, "a b")), tokenizer(), capacity=8).collect()
    ids = np.frombuffer(row["ids"], "<u4")
    assert (len(ids), ids[-1], row["length"]) == (3, 0, 3)


def test_empty_table(docs):
    assert packing_report(docs().limit(0), tokenizer()).count() == 0


@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_best_fit_places_every_piece_once(counts):
    capacity, used, by_length = 40, Counter(), Counter()
    spans = {}
    for length, rank, first, offset in best_fit(counts, capacity):
        spans.setdefault(length, []).append((rank, first, offset))
    for length, n in counts.items():
        steps = sorted(spans[length])
        for r in range(n):
            rank, first, offset = [s for s in steps if s[0] <= r][-1]
            place = (first + r - rank, offset)
            for t in range(length):
                used[place[0], place[1] + t] += 1
            by_length[length] += 1
    assert by_length == Counter(counts)
    assert set(used.values()) <= {1}
    assert all(0 <= at < capacity for _, at in used)
    bins = len({s for s, _ in used})
    # Plain best-fit decreasing, piece by piece.
    gaps = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fitting = [g for g in gaps if g >= length]
        gap = min(fitting) if fitting else capacity
        if fitting:
            gaps.remove(gap)
        gaps.append(gap - length)
    assert bins <= len(gaps) + 1


def test_runs_by_their_bytes(plain_tokenizer):
    """Runs of 7 to 26 bytes, digits and signs between letters, and letters of two bytes at every place."""
    parts = ["a" * n for n in range(6, 28)] + ["é" * n for n in range(3, 14)] + ["x" * 23 + "É", "A1b2,c", "7", "d.e", "×a÷", "ªb", "ÀÞ"]
    texts = [" ".join(parts[i:] + parts[:i]) for i in range(len(parts))]
    for text, got in zip(texts, WordEncoder(tokenizer()).encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids


def test_a_table_of_runs_grows():
    table, random = RunTable(room=4), np.random.default_rng(3)
    keys = [random.integers(0, 40, 500).astype(np.uint64) for _ in range(3)]
    different = np.unique(np.stack(keys), axis=1)
    for block in np.array_split(np.arange(different.shape[1]), 7):
        part = [k[block] for k in different]
        assert (table.find(part) == -1).all()
        assert table.find(part).tolist() != table.reserve(len(block), part).tolist()
    assert table.find(list(different)).tolist() == list(range(different.shape[1]))
    assert table.find([np.array([99], np.uint64)] * 3).tolist() == [-1]


def test_any_columns_are_carried(spark, docs):
    docs()
    names = "doc_id long, length long, size string, part string, rank string, n string, c0 string, before string, `a.b` string, sequence_id string, `offset` string"
    pieces = spark.createDataFrame([(1, 5, *"abcdefghi"), (1, 5, *"abcdefghi"), (None, 7, *[None] * 9)], names)
    found = pack_pieces(pieces, capacity=10).collect()
    assert sorted(tuple(r)[2:9] for r in found if r["doc_id"]) == [tuple("abcdefg")] * 2
    assert sorted((r["length"], r["offset"]) for r in found) == [(5, 0), (5, 5), (7, 0)]
    with pytest.raises(Exception, match="lengths must be from 1 to 6"):
        pack_pieces(pieces, capacity=6)


def test_a_length_that_most_pieces_share(spark):
    rows = [(i, 0, 7) for i in range(900)] + [(i, 0, 1 + i % 9) for i in range(100)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    found = pack_pieces(pieces, capacity=20).collect()
    used = Counter((r["sequence_id"], r["offset"] + t) for r in found for t in range(r["length"]))
    assert len(found) == 1000 and set(used.values()) == {1}
