import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from wardledger.llm.sharding import assign_shards, shard_report, split_shards


def bits(key):
    return f"{int(hashlib.md5(str(key).encode()).hexdigest()[:12], 16):048b}"


def plain(rows, limit):
    """Split the oversized shard, bit by bit."""
    open_, shards = [("", rows)], {}
    while open_:
        prefix, mine = open_.pop()
        if not mine:
            continue
        if sum(n for _, n in mine) <= limit or len(mine) == 1 or len(prefix) == 48:
            shards[prefix] = mine
            continue
        halves = defaultdict(list)
        for key, n in mine:
            halves[bits(key)[: len(prefix) + 1]].append((key, n))
        open_ += halves.items()
    return {key: prefix for prefix, mine in shards.items() for key, _ in mine}


def test_shards_match_splitting_one_by_one(docs, monkeypatch):
    rows = [(i, "x" * (i % 97)) for i in range(3000)] + [(5000, "y" * 900)]
    expected = plain([(i, len(t)) for i, t in rows], 400)
    df = docs(*rows)
    found = assign_shards(df, 400)
    assert found.columns == [c for c in df.columns if c != "shard_id"] + ["shard_id", "shard_depth", "oversized"]
    got = {r["doc_id"]: (r["shard_id"], r["oversized"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == expected
    assert [k for k, v in got.items() if v[1]] == [5000]


def test_more_bits_only_for_open_shards(spark):
    rows = [(f"{i:064b}", 1) for i in range(64)] + [("1" * 64, 5)]
    df = spark.createDataFrame(rows, "address string, bytes long")
    found = {r["shard_id"]: (r["bytes"], r["n_rows"]) for r in split_shards(df, 8, step=10).collect()}
    assert found["1"] == (5, 1)
    assert sum(n for b, n in found.values()) == 65 and all(b <= 8 for b, n in found.values())


def test_one_key_for_many_rows_still_splits(docs):
    rows = [(7, "z" * 100)] * 200 + [(None, "z" * 100)] * 100 + [(1, None), (2, "")]
    found = assign_shards(docs(*rows), 2000).groupBy("shard_id").agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in found) == 302 and max(r["b"] or 0 for r in found) <= 2000


def test_one_shard_and_none(docs):
    (r,) = shard_report(docs((1, "ab")), 10).collect()
    assert (r["n_bytes"], r["shard_id"], r["shard_depth"], r["oversized"]) == (2, "", 0, False)
    assert shard_report(docs().limit(0), 10).count() == 0
