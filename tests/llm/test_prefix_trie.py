import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spark_setup import prepare
from wardledger.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain(rows):
    """The nodes by their definition: every prefix of every conversation."""
    paths = rebuilt(rows)
    members = {}
    for c, ts in paths.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for node, of in members.items():
        below = [m for m in members if m[: len(node)] == node]
        parents = {m[:-1] for m in members if m}
        ends = sorted(c for c in of if len(paths[c]) == len(node))
        out.append((
            min(of), len(node), min(members[node[:-1]]) if node else None, len(of),
            sum(len(m) == len(node) + 1 for m in below), sum(m not in parents for m in below),
            sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*pt._NODE).collect()), key=str)


def conversations(seed=1, n=250):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), *range(900, 950), -7, -100, 10**12 + 3]:
        for turn in range(r.randrange(0, 9)):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["hi", "hö 🙂", "", None, "ok"])))
    for c in range(2000, 2600):  # many copies of one conversation
        rows += [(c, t, "user", f"copy {t}") for t in range(4)]
    rows += [(3000, None, "system", "first"), (3000, 0, "user", "second"), (3000, 7, "user", "third")]
    rows += [(None, 0, "user", "nobody's")]
    r.shuffle(rows)
    return rows


@pytest.fixture
def data(spark):
    prepare(spark)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("path", "shard", "turns", "depth", "kind", "skeleton"):
        df = df.withColumn(name, F.lit("x"))
    return rows, df


def test_report_matches_the_definition(data):
    rows, df = data
    assert found(pt.trie_report(df)) == plain(rows)


@pytest.mark.parametrize(("shards", "limit", "piece"), [(1, 1 << 17, 1 << 16), (40, 1 << 17, 64), (300, 1 << 17, 8), (40, 10, 1 << 16)])
def test_nothing_depends_on_the_shards(data, monkeypatch, shards, limit, piece):
    monkeypatch.setattr(pt, "_PIECE", piece)
    monkeypatch.setattr(pt, "_ROWS", 5)
    rows, df = data
    turns = pt.rebuilt(pt.conversation_turns(df))
    assert found(pt.prefix_trie(turns, shards=shards, skeleton_turns=limit)) == plain(rows)


def test_skeleton_stays_below_its_limit():
    paths = sorted((bytes([i]) * 24 * 50, i) for i in range(100))
    skeleton = pt.Skeleton(paths, 500)
    assert len(skeleton.parent) <= 501 and skeleton.splitters
    assert all(up < i for i, up in enumerate(skeleton.parent))


def test_long_conversation_and_empty_table(spark):
    prepare(spark)
    rows = [(5, t, "user", f"turn {t}") for t in range(3000)] + [(6, t, "user", f"turn {t}") for t in range(2990)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = pt.prefix_trie(pt.conversation_turns(df), shards=8)
    assert nodes.count() == 3001
    root = nodes.filter("depth = 0").first()
    assert (root.n_convs, root.n_children, root.n_leaves) == (2, 1, 1)
    assert root.saved_tokens == sum(len(f"turn {t}") for t in range(2990))
    assert pt.trie_report(df.limit(0)).count() == 0


def test_repeated_numbers_have_one_order(spark):
    prepare(spark)
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "b")]
    nodes = found(pt.prefix_trie(pt.conversation_turns(spark.createDataFrame(rows, SCHEMA))))
    assert nodes == found(pt.prefix_trie(pt.conversation_turns(spark.createDataFrame(rows[::-1], SCHEMA))))
    assert max(n[1] for n in nodes) == 3
