"""Claims are built in steps: what a step leaves on the disk, and what moves in it."""

import datetime as dt
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_exchanges import moves, shuffled  # noqa: F401
from wardledger.operators import claim_diseases as D
from wardledger.operators import claim_items as C
from wardledger.operators import prescriptions as P
from wardledger.operators.claim_frame import ClaimFrame
from wardledger.options import RunContext
from wardledger.plans.claim_build import build_claims
from wardledger.session import SHUFFLE_CLEANUP, Workspace, together
from wardledger.sources.derived import derived_tables

SF = "/root/testdata/sf0.001"
RUN = RunContext(dt.datetime(2002, 3, 4, 5, 6, 7))


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for folder in folders for p in Path(str(folder)).rglob("shuffle_*.data")}


def test_a_kept_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    with Workspace(spark) as space:
        kept = together(
            lambda: space.keep(spark.range(1000).repartition(4, "id"), "plain"),
            lambda: space.keep(spark.range(1000).withColumn("k", F.col("id") % 7), "bucketed", by=("k",)),
        )
        until = time.time() + 20
        while shuffle_files(spark) - before and time.time() < until:  # Spark removes them in the background
            time.sleep(0.2)
        assert not shuffle_files(spark) - before
        assert [df.count() for df in kept] == [1000, 1000]
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting


def test_lookups_in_place_find_the_same_and_move_no_row(shuffled, tables):  # noqa: F811
    """Repeated rows and templates, blank and unknown keys, the same name in several kinds and encounters."""
    t = tables(
        item_template=[{"template_type": k, "name": n, "item": i} for k, n, i in (
            ("Medication", "a", "I"), ("Medication", "a", "J"), ("Therapy Type", "a", "K"), ("Medication", "b", None),
            ("Medication", "", "no"), ("Other", "a", "no"))],
        approval=[{"ref_doctype": k, "ref_docname": d, "approval_number": n} for k, d, n in (
            ("Lab Test", "d", "2"), ("Lab Test", "d", "1"), ("Clinical Procedure", "d", "3"), ("Other", "d", "0"), ("Lab Test", "", "no"))],
    )
    rows = shuffled.createDataFrame(
        [(p, name, order, template, document) for p in ("E", "F", "G") for name, order, template, document in (
            ("1", 3, "a", None), ("1", 3, "a", None), ("2", 4, "a", "d"), ("3", 3, "b", ""), ("4", 3, "", None), ("5", 3, None, None),
            ("6", 3, "gone", "gone"), ("7", 0, "a", "d"), ("8", 2, "a", "d"), ("9", 0, "a", "gone")) if p != "G" or name > "4"],
        "parent string, name string, table_order int, template string, document string",
    )
    with Workspace(shuffled) as space:
        kept = space.keep(rows, "rows", by=("parent",))
        found = P.looked_up_in_place(kept, t)
        columns = [*rows.columns, "item_code", "approval_ref_no"]
        expected = P.with_item(P.with_approval(rows, t), t).select(*columns)
        assert moves(found) == 6  # the wanted templates and documents, what is known of them, and what was found
        assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, expected.collect()))
        assert expected.count() == 29


def test_equal_diagnoses_give_the_least_of_each_field(shuffled, tables):  # noqa: F811
    """An entry and an encounter that are stored twice, with other values; descriptions move only for who reads them."""
    code = {"name": "c", "parent": "E", "parenttype": "Patient Encounter", "parentfield": D.FINAL, "medical_code": "m", "code": "A01"}
    visit = {"name": "E", "appointment": "A", "docstatus": 1}
    t = tables(
        codification_table=[{**code, "description": d} for d in ("y" * 200, "x" * 200)] + [{**code, "name": "d", "description": "a"}],
        patient_encounter=[{**visit, "practitioner": p} for p in ("q", "p")],
        insurance_claim=[{"name": "C", "patient_appointment": "A"}],
    )
    found = D.claim_diseases(t.insurance_claim, t)
    assert [(r.codification_table, r.description, r.item_crt_by, r.status) for r in found.collect()] == [("c", "x" * 139, "p", "Final")]
    plan = found.select("claim", "status", "disease_code")._jdf.queryExecution().executedPlan().toString()
    assert "substring(description" not in plan


def test_listed_appointments_of_a_claim_are_chargeable_ones(tables):
    t = tables(
        insurance_claim=[{"name": "C", "company": "co", "patient_appointment": "A", "claim_appointment_list": '["A","B","D"]'}],
        patient_appointment=[
            {"name": "A", "follow_up": 1, "paid_amount": 5.0, "insurance_company": "i"},
            {"name": "B", "paid_amount": 6.0, "insurance_company": "i"},
            {"name": "D", "has_no_consultation_charges": 1},
        ],
    )
    found = ClaimFrame(t.insurance_claim, t, keep=()).appointments.collect()
    assert sorted((r.position, r.appointment, r.paid_amount, r.insurance_company, r.claim_company) for r in found) == [
        (-1, "A", 5.0, None, None), (1, "B", None, "i", "co")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_documents_are_joined_where_their_claim_lies(shuffled):  # noqa: F811
    t = derived_tables(shuffled, SF)
    built = build_claims(t.insurance_claim.limit(50), t, RUN)
    assert moves(built.documents) <= 3  # of the folio numbers


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_prescribed_rows_move_by_encounter_and_by_claim_only(shuffled):  # noqa: F811
    lines = entry.queries()["c9_claim_lines"](shuffled, SF)
    assert moves(lines) <= 10
    assert C.LINE_COLUMNS == lines.columns[1:]
