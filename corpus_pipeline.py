"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each one operator of ``wardledger.llm`` with its decisions carried out: documents without a recognized
language go, one document of each near-duplicate group stays, contaminated documents go, personal data becomes
pseudonyms, and what is left is packed. All stages but the last return the columns of ``documents``.

Rows without an id belong to no near-duplicate group and stay. Of several rows with one id one stays, the one with
the smallest text. A null or empty text has no language and goes at the first stage; such texts among the documents of
a later stage stay (an empty text is no near duplicate and holds no benchmark words). Empty tables give empty tables.
Further columns of any names are carried as they are; a map column is not, since no stage could compare it.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from spark_setup import prepare  # noqa: E402
from wardledger.llm.decontaminate import find_contamination, with_verdict  # noqa: E402
from wardledger.llm.langid import fit, identified  # noqa: E402
from wardledger.llm.names import free_name  # noqa: E402
from wardledger.llm.near_duplicates import near_duplicates  # noqa: E402
from wardledger.llm.packing import packing_report  # noqa: E402
from wardledger.llm.pseudonyms import pseudonymize  # noqa: E402
from wardledger.llm.queries import DEMONSTRATION_KEY, table, tokenizer  # noqa: E402
from wardledger.session import Workspace  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return identified(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = near_duplicates(docs.select("doc_id", "text"))
    first = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    place = free_name(docs, "place")
    kept = docs.join(first, "doc_id", "left_semi").withColumn(place, one).filter(F.col(place) == 1)
    return kept.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = docs.select("text", F.struct(*docs.columns).alias("document"))
    found = with_verdict(find_contamination(rows, table(spark, sf_dir, "benchmark"), carry=("document",)))
    return found.filter(~F.col("contaminated")).select("document.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonymize(docs, DEMONSTRATION_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing_report(docs, tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Models, signatures and tokenizers are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each reading what the one before has written."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark) as space:
        for name, stage in STAGES[:-1]:
            docs = space.keep(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
