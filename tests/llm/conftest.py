import pytest

from spark_setup import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of (id, text) or (id, text, lang) rows, with further columns named like operators' own."""
    prepare(spark)

    def make(*rows, clash=True):
        full = [(*r[:2], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            for name in ("id", "row", "n", "score", "spans", "bands", "component_id", "sequence_id", "shard_id", "__slot", "digest", "counts"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def words():
    """Deterministic invented words."""
    import random

    def make(n, seed=0, vocabulary=5000):
        r = random.Random(seed)
        return [f"w{r.randrange(vocabulary)}" for _ in range(n)]

    return make
