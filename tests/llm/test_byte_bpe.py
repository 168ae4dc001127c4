import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from wardledger.llm import byte_bpe as bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed=1):
    r = random.Random(seed)
    kinds = ["abcdefghij", "aeiou ", " \n\t\r 　", "0123456789½²", "äöüßéèç'", "日本語テキスト", "🙂👩‍👩‍👧🏽", "'s't're", "!?.,;:-_=+/"]
    out = ["".join(chr(c) for c in range(0x20, 0x250)), "a" * 700, "<|endoftext|> <|startoftext|>", " ", "\x00\x1c\x85", "xyz" * 2000]
    return out + ["".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(0, 120))) for _ in range(n)]


def test_ids_are_the_librarys(library):
    texts = odd_texts(3000)
    encoder = bpe.Encoder(PATH, PATTERN)
    count, ids = encoder.texts([t.encode() for t in texts])
    expected = [library.encode_ordinary(t) for t in texts]
    assert count.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]
    n, data = encoder.vocabulary.decoded(ids)
    assert data.tobytes() == "".join(texts).encode() and len(n) == len(ids)


@pytest.mark.parametrize(("widest", "cells"), [(512, 1 << 18), (8, 64), (0, 64)])
def test_widths_and_heap_agree(library, monkeypatch, widest, cells):
    monkeypatch.setattr(bpe, "WIDEST", widest)
    monkeypatch.setattr(bpe, "CELLS", cells)
    r = random.Random(5)
    pieces = ["".join(r.choice("abcdeäß日🙂") for _ in range(r.randrange(1, 40))).encode() for _ in range(500)]
    count, ids = bpe.Vocabulary(PATH).pieces(pieces)
    ends = np.cumsum(count)
    for piece, start, end in zip(pieces, ends - count, ends, strict=True):
        assert ids[start:end].tolist() == library._core_bpe.encode_single_piece(piece)


def test_remembering_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 3)
    monkeypatch.setattr(bpe, "_RUN", 2)
    encoder = bpe.Encoder(PATH, PATTERN)
    for text in ["one two three four", "two three five", "", "one one one one one", "drei vier fünf"]:
        assert encoder.texts([text.encode()])[1].tolist() == library.encode_ordinary(text)


def test_report(docs, library):
    long = " ".join(f"w{i % 977}x" for i in range(200_000)) + "q" * 50_000
    rows = [(1, None), (2, ""), (3, "Grüße, world's end"), (3, "Grüße, world's end"), (None, "no id"), (4, long)]
    found = {}
    for row in bpe.token_report(docs(*rows).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("y")), PATH, PATTERN).collect():
        found.setdefault(row.doc_id, []).append(row)
    for doc_id, text in dict(rows).items():
        ids = library.encode_ordinary(text or "")
        for row in found[doc_id]:
            assert row.n_tokens == len(ids)
            assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert len(found[3]) == 2 and sum(map(len, found.values())) == len(rows)
    assert bpe.token_report(docs(*rows).limit(0), PATH, PATTERN).count() == 0


def test_columns_and_odd_ids(docs, spark, library):
    out = bpe.encode(docs((1, "some text"), (2, None)).withColumn("ids", F.lit("x")), PATH, PATTERN)
    assert "text" not in out.columns and out.columns.count("ids") == 1 and {"lang", "n"} <= set(out.columns)
    rows = [(1, [library.encode_ordinary("a")[0], None, -5, 10**9]), (2, None), (3, [])]
    back = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: bytearray("a���".encode()), 2: None, 3: bytearray()}
