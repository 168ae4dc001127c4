"""Registered queries against their SQL, and their plans, also of what they keep on the way."""

import os
import re

import pytest

import __spark_entry__ as entry
from oracle import oracle_queries
from tests.compare import compare, duck
from wardledger.plans.catalog import registered_queries
from wardledger.session import Workspace
from wardledger.sources.schemas import REVENUE

SF = "/root/testdata/sf0.001"
ORACLE = oracle_queries()
QUERIES = {n: q for n, q in entry.queries().items() if n in registered_queries()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_every_survey_operator_is_registered():
    groups = {"r": 12, "h": 12, "c": 13, "m": 4, "t": 7, "v": 13, "s": 13}
    missing = [
        f"{letter}{n}"
        for letter, last in groups.items()
        for n in range(1, last + 1)
        if not any(re.match(rf"{letter}{n}_", q) for q in QUERIES)
    ]
    assert missing == []


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, con, name, monkeypatch):
    built = []
    keep = Workspace.keep

    def watched(self, df, *how, **more):
        built.append(df)
        return keep(self, df, *how, **more)

    monkeypatch.setattr(Workspace, "keep", watched)

    def query(session, sf_dir):
        built.append(QUERIES[name](session, sf_dir))
        return built[-1]

    rows, expected, difference = compare(spark, con, SF, name, query, ORACLE[name])
    assert difference is None
    assert rows == expected > 0
    for df in built:
        plan = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan


def test_entry_has_the_report_columns(spark):
    assert entry.entry(spark).columns == [f.name for f in REVENUE.fields]
