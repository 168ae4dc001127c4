import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_setup import prepare
from wardledger.llm import hamming_search as hs


def plain(rows, k, bits):
    codes = {(i, tuple(x is not None and x > 0 for x in v)) for i, v in rows if i is not None and v is not None and len(v) == bits}
    out = []
    for i, q in codes:
        if i % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(q, c, strict=True)), j) for j, c in codes)[:k]
            out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.fixture
def vectors(spark):
    prepare(spark)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=32).tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 420)]  # one very common vector
    rows += [(i, [x if r.random() < 0.95 else -x for x in rows[7][1]]) for i in range(420, 460)]
    rows += [(460, None), (None, rows[0][1]), (480, [0.5] * 8), (500, [None] + rows[3][1][1:]), (20, rows[20][1])]
    return rows


@pytest.mark.parametrize(("codes", "queries"), [(1 << 16, 512), (50, 4)])
def test_matches_brute_force(spark, vectors, monkeypatch, codes, queries):
    monkeypatch.setattr(hs, "_CODES", codes)
    monkeypatch.setattr(hs, "_QUERIES", queries)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("code", F.lit(1)).withColumn("id", F.lit(2))
    found = sorted(tuple(r) for r in hs.search_report(df, k=10, bits=32).collect())
    assert found == plain(vectors, 10, 32)


def test_fewer_than_k_and_none(spark):
    prepare(spark)
    df = spark.createDataFrame([(0, [1.0] * 16), (1, [-1.0] * 16)], "vec_id long, embedding array<float>")
    found = [tuple(r) for r in hs.search_report(df, k=10, bits=16).orderBy("rank").collect()]
    assert found == [(0, 1, 0, 0), (0, 2, 1, 16)]
    assert hs.search_report(df.limit(0), k=10, bits=16).count() == 0
    with pytest.raises(ValueError):
        hs.nearest_codes(df, F.lit(True), 1, 20)


def test_search_stops_when_covered():
    r = np.random.default_rng(4)
    codes = r.integers(0, 1 << 16, (5000, 4)).astype(np.uint32)
    codes[:30] = codes[0] ^ (1 << r.integers(0, 16, (30, 4)).astype(np.uint32))
    places, distances = hs.MultiIndex(codes).nearest(codes[0], 5)
    assert len(places) < 1000
    full = np.bitwise_count(codes ^ codes[0]).sum(axis=1)
    assert np.sort(distances)[:5].tolist() == np.sort(full)[:5].tolist()
