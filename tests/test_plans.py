import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from wardledger.options import RunContext
from wardledger.plans.claim_build import build_claims, submit_claims
from wardledger.sources.derived import derived_tables

SF = "/root/testdata/sf0.001"
RUN = RunContext(dt.datetime(2002, 3, 4, 5, 6, 7))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_submission_tracks_submitted_claims_only(spark):
    t = derived_tables(spark, SF)
    violations, changes = submit_claims(t.insurance_claim, t, RUN)
    submitted = t.insurance_claim.filter("docstatus = 1").select(F.col("name").alias("insurance_claim"))
    assert changes.count() > 0
    assert changes.join(submitted, "insurance_claim", "left_anti").count() == 0
    assert violations.columns == ["claim", "rule", "detail"]


def test_totals_are_the_sums_of_the_lines(spark):
    t = derived_tables(spark, SF)
    built = build_claims(t.insurance_claim, t, RUN)
    lines = built.lines.agg(F.sum((F.col("unit_price") * F.col("item_quantity")).cast("decimal(18,4)"))).first()[0]
    totals = built.totals.agg(F.sum(F.col("total_amount").cast("decimal(18,4)"))).first()[0]
    assert lines == totals > 0
