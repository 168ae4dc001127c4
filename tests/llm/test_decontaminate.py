import hashlib
import random
import re

import pytest

from wardledger.llm import decontaminate
from wardledger.llm.decontaminate import contamination_report, find_contamination, merged, with_verdict

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, n=13):
    """Read off the contract: n_words, hit places, items."""
    words, hit, names = split(text), set(), set()
    for item, other in items:
        w = split(other)
        k = min(n, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                names.add(str(item)) if item is not None else None
    return len(words), len(hit), sorted(names)


@pytest.fixture
def case(words):
    items = [(i, " ".join(words(40, seed=i, vocabulary=60))) for i in range(6)]
    items += [(90, "Short, item"), (91, ""), (92, None), (None, " ".join(words(20, seed=77))), (3, items[3][1])]
    items += [(93, "a " * 30)]
    r = random.Random(5)
    rows = []
    for i in range(30):
        text = words(60, seed=100 + i, vocabulary=60)
        if i % 3 == 0:
            part = items[i % 6][1].split()
            at = r.randrange(20)
            text[10:10] = part[at : at + r.randrange(11, 20)]
        rows.append((i, " ".join(text)))
    rows += [(40, None), (41, ""), (42, "short-ITEM"), (43, "a a " * 50), (44, items[0][1]), (44, items[0][1]), (None, items[1][1])]
    rows += [(45, " ".join(words(60_000, seed=9)) + " " + items[2][1])]
    return rows, items


@pytest.mark.parametrize("block_bytes", [8 << 20, 600])
def test_matches_a_plain_search(spark, docs, case, block_bytes):
    rows, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = with_verdict(find_contamination(docs(*rows), benchmark, block_bytes=block_bytes))
    assert found.columns[0] == "doc_id"
    got = sorted(((r["doc_id"] or -1), r["n_words"], r["n_hit"], r["items"]) for r in found.collect())
    assert got == sorted(((i or -1), *plain(text, items)) for i, text in rows)


def test_repeats_do_not_swell_a_block(spark, docs, case, monkeypatch):
    rows, items = case
    items = items + [items[0]] * 100
    plain_windows, sizes = decontaminate.item_windows, []

    def measured(block, n):
        sizes.append([64 + len(words) for _, words in block])
        return plain_windows(block, n)

    monkeypatch.setattr(decontaminate, "item_windows", measured)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = with_verdict(find_contamination(docs(*rows), benchmark, block_bytes=600)).collect()
    assert len(sizes) > 1 and all(sum(s) <= 600 + max(s) for s in sizes if s)
    got = sorted(((r["doc_id"] or -1), r["n_words"], r["n_hit"], r["items"]) for r in found)
    assert got == sorted(((i or -1), *plain(text, items)) for i, text in rows)


def test_report(spark, docs, case):
    rows, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for r in contamination_report(docs(*rows), benchmark).collect():
        n, hit, names = plain(dict(rows)[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in contamination_report(docs((1, "a b")), none).collect()] == [0]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination_report(docs().limit(0), some).count() == 0


def test_spans_merge():
    assert merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
