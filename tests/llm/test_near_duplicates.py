import random
import re

import numpy as np
import pytest

from wardledger.llm import near_duplicates as nd
from wardledger.llm.components import connected_components
from wardledger.session import Workspace


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """Smallest reachable id by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, n, r):
    out = list(text)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


@pytest.fixture
def rows(words):
    r = random.Random(3)
    out, at = [], 0
    for family in range(8):
        base = words(120, seed=family)
        for _ in range(r.randrange(1, 12)):
            out.append((at, " ".join(edited(base, r.randrange(0, 6), r))))
            at += 1
    chain = words(200, seed=50)  # each a bit further from the first
    for _ in range(12):
        chain = edited(chain, 3, r)
        out.append((at, " ".join(chain)))
        at += 1
    out += [(at + k, t) for k, t in enumerate(["", None, "one two", "One  TWO\n", "two one", "a b c d e", "x"])]
    r.shuffle(out)
    return out


def check(found, rows):
    expected = plain([x for x in rows if x[0] is not None])
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_groups_match_all_pairs(docs, rows):
    found = nd.duplicate_report(docs(*rows)).collect()
    assert len(found) == len(rows)
    check(found, rows)


def test_links_missed_by_the_smallest_member_are_found(docs, words):
    """In a bucket of many, links that the smallest member has no part in."""
    r = random.Random(1)
    shared = words(60, seed=1)
    rows = []
    for family in range(6):
        base = shared + words(50, seed=10 + family)
        rows += [(10 * family + k, " ".join(edited(base, 2, r))) for k in range(6)]
    check(nd.duplicate_report(docs(*rows)).collect(), rows)


def test_odd_rows(docs, words):
    text = " ".join(words(50, seed=1))
    rows = [(7, text), (7, text), (3, text), (None, text), (None, None), (9, " ".join(words(40_000, seed=2)))]
    found = nd.duplicate_report(docs(*rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found if r["doc_id"]) == [
        (3, 3, True),
        (7, 3, False),
        (7, 3, False),
        (9, 9, True),
    ]
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None, None]
    assert nd.duplicate_report(docs().limit(0)).count() == 0


def test_superminhash_estimates_and_stops_early():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 2**63, 300).astype(np.uint64) for _ in range(2))
    both = np.concatenate([a[:200], b[:100]])
    values = nd.signatures([np.unique(a), np.unique(both), a[:1], a[:0]], 96)
    assert abs((values[0] == values[1]).mean() - 200 / 400) < 0.2
    assert (np.sort(values[2] >> np.uint64(32)) == np.arange(96)).all()  # one element visits each slot once
    assert (values[3] == values[3].max()).all()
    # The definition, element by element.
    slow = np.full(96, 2**64 - 1, np.uint64)
    for element in np.unique(a):
        slow = np.minimum(slow, nd.signatures([np.array([element])], 96)[0])
    assert (slow == values[0]).all()


def test_components_of_stars_and_paths(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    found = dict(connected_components(df, Workspace(spark)).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 201: 200}
