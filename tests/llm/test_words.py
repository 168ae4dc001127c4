import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardledger.llm.words import BLANKS, NON_ALPHANUMERIC, chunks, runs_hashes, word_hashes

RULES = {"blank": (BLANKS, r"[^\x20\x09-\x0D]+"), "alphanumeric": (NON_ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("rule", RULES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("aAbZ09 \t\x0b\x00\x1c.-é  ß")), max_size=6))
def test_words_follow_the_pattern(rule, texts):
    table, pattern = RULES[rule]
    hashes, bounds = word_hashes([t.encode() for t in texts], table)
    expected = [re.findall(pattern, lowered(t)) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in expected]
    known = {}
    for word, h in zip([w for ws in expected for w in ws], hashes.tolist(), strict=True):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_long_texts_are_hashed_in_pieces_alike():
    text = " ".join(f"word{i % 977}" for i in range(400_000)).encode()
    hashes, bounds = word_hashes([text, b"word5 x"], BLANKS)
    assert bounds.tolist() == [0, 400_000, 400_002]
    assert hashes[400_000] == hashes[5]


def test_runs_depend_on_order():
    a = np.array([1, 2, 3, 1, 2], np.uint64)
    assert len(runs_hashes(a, 2)) == 4 and runs_hashes(a, 2)[0] == runs_hashes(a, 2)[3]
    assert runs_hashes(a[:2], 2)[0] != runs_hashes(a[1::-1], 2)[0]
    assert len(runs_hashes(a, 6)) == 0


def test_chunks_cover_all_texts():
    assert list(chunks([b"a" * 5, b"", b"b" * 9, b"c"], 6)) == [(0, 2), (2, 3), (3, 4)]
    assert list(chunks([])) == []
