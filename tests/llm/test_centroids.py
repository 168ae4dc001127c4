import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_setup import prepare
from wardledger.llm import centroids as ce


def plain(rows, k, rounds, dims):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) by the definition, in Python numbers."""
    kept = [
        (i, [int(np.floor(1024 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centers]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[0], []).append(v)
        for c, vs in members.items():
            centers[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    of = {c: sum(d for _, x, d in found if x == c) for c in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, of[c], sum(of.values()), sha[c]) for i, c, d in found), key=str)


def report(df, **options):
    rows = ce.cluster_report(df, **options).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows), key=str)


@pytest.fixture
def vectors(spark):
    prepare(spark)
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=16) + (i % 5)).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 400)]  # a third of one vector
    rows += [(400, None), (401, [1.0] * 15), (402, [None, *rows[0][1][1:]]), (403, [float("nan")] * 16)]
    rows += [(404, [float("inf"), *rows[0][1][1:]]), (None, rows[1][1]), (2, rows[2][1]), (2, rows[3][1]), (405, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for name in ("cluster", "distance", "chunk", "shard", "id", "cells", "ids", "inertia"):
        df = df.withColumn(name, F.lit("x"))
    return rows, df


@pytest.mark.parametrize(("shards", "chunk"), [(1, 1024), (3, 7), (16, 50), (99, 1024)])
def test_matches_the_definition(vectors, monkeypatch, shards, chunk):
    monkeypatch.setattr(ce, "_CHUNK", chunk)
    rows, df = vectors
    assert report(df, dims=16, shards=shards) == plain(rows, 8, 10, 16)


def test_empty_clusters_keep_their_centroid(spark):
    prepare(spark)
    rows = [(i, [1.0, -2.5]) for i in range(20)] + [(20, [1.001, -2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert report(df, dims=2) == plain(rows, 8, 10, 2)


def test_few_none_and_too_large(spark):
    prepare(spark)
    rows = [(0, [0.25, -0.0001]), (1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert report(df, dims=2) == plain(rows, 8, 10, 2)
    assert report(df.limit(0), dims=2) == []
    assert report(df, dims=3) == []
    with pytest.raises(Exception, match="too large"):
        report(df.select("vec_id", F.transform("embedding", lambda x: x * 1e9).alias("embedding")), dims=2)


def test_each_shard_moves_no_vectors(vectors, monkeypatch):
    """Partial distances of the shards add up to the whole ones."""
    r = np.random.default_rng(1)
    x, c = r.integers(-5000, 5000, (50, 16)), r.integers(-5000, 5000, (4, 16))
    parts = [ce._partial(x[:, a:b].astype("<i4").tobytes(), c[:, a:b]) for a, b in ((0, 5), (5, 16))]
    assert (sum(parts) == ((x[:, None] - c[None]) ** 2).sum(-1)).all()
