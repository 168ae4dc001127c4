import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import compare, duck
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_near_duplicates import plain as plain_groups
from wardledger.llm.oracle import llm_oracle
from wardledger.llm.queries import llm_queries, tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(llm_oracle()))
def test_query_matches_sql(spark, name):
    rows, expected, difference = compare(spark, duck(SF), SF, name, entry.queries()[name], llm_oracle()[name])
    assert difference is None and rows == expected > 0


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_query_returns_a_row_for_each_input_row(spark, name):
    table = {"op5": "conversations", "op9": "embeddings"}.get(name.split("_")[0], "documents")
    found = entry.queries()[name](spark, SF).count()
    assert found >= spark.read.parquet(f"{SF}/{table}.parquet").count() // 20


def test_stages_match_plain_versions(spark, tmp_path):
    """Each stage on what the one before kept; model decisions are taken from the stage itself."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
        if name != "packing":
            assert docs.columns == columns
    original = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    language, groups, clean, private, packed = kept
    assert len(language) >= 0.98 * len(original)
    expected = {i for i, (_, top) in plain_groups([(r["doc_id"], r["text"]) for r in language]).items() if i == top}
    assert {r["doc_id"] for r in groups} == expected and len(groups) == len(expected)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {r["doc_id"]: plain_hits(r["text"], items) for r in groups}
    assert {r["doc_id"] for r in clean} == {i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
    assert {r["doc_id"] for r in private} == {r["doc_id"] for r in clean}
    assert all(r["n_chars"] == len(r["text"]) for r in private)
    assert not any("@mail" in r["text"] and ".example.com" in r["text"] for r in private)
    plain = Tokenizer.from_file(tokenizer())
    want = {}
    for r in private:
        ids = np.array(plain.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        want |= {(r["doc_id"], k): zlib.crc32(ids[at : at + 2048].tobytes()) for k, at in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packed} == want


def test_run_gives_the_same_rows(spark):
    first = corpus_pipeline.run(spark, SF)
    assert first.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = {tuple(r) for r in first.collect()}
    assert rows == {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}


def test_near_dedup_keeps_one_row_of_repeated_documents(spark):
    docs = spark.createDataFrame(
        [(1, "a b c"), (1, "a b c"), (2, "A b c"), (3, ""), (4, None), (None, "a b c")], "doc_id long, text string"
    )
    found = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in found) == [0, 1, 3, 4]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_carry_columns_of_any_name_and_take_empty_tables(spark, name):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("id", "row", "place", "document", "spans", "items", "n_words", "contaminated", "found", "component_id", "Text_", "n_hit", "rows", "order")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, docs, SF)
    assert found.columns == docs.columns
    rows = found.collect()
    assert len(rows) > 0.5 * docs.count() and all(r[c] == f"own {c}" for r in rows for c in names)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_with_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, None), (3, "x" * 300_000)], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, docs, SF).count() == 4
    assert corpus_pipeline.decontamination(spark, docs, SF).count() == 4
