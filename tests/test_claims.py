import datetime as dt
import json

from pyspark.sql import functions as F

from wardledger.functions.columns import disease_code
from wardledger.operators import claim_changes as G
from wardledger.operators import claim_checks as V
from wardledger.operators import claim_header as H
from wardledger.operators import claim_items as C
from wardledger.operators import claim_reconcile as M
from wardledger.operators.claim_export import folio_documents
from wardledger.options import RunContext

RUN = RunContext(dt.datetime(2023, 6, 1, 12, 30, 0))
T0 = dt.datetime(2023, 5, 1, 8, 0)


def claim(name="ICN-000000001", **more):
    return {"name": name, "patient_appointment": "A1", "patient": "PT", "cardno": "C", "company": "CO", "docstatus": 0,
            "coverage_plan_name": "Plan", "attendance_date": dt.date(2023, 5, 1), "creation": T0, **more}


def test_appointments_of_a_claim(table):
    claims = table(
        "insurance_claim", claim("a"), claim("b", claim_appointment_list='["A2", "A3"]'),
        claim("c", claim_appointment_list=""), claim("d", claim_appointment_list="[]"),
    )
    rows = {(r.claim, r.position, r.appointment) for r in H.claim_appointments(claims).collect()}
    assert rows == {("a", 0, "A1"), ("b", 0, "A2"), ("b", 1, "A3"), ("c", 0, "A1"), ("d", 0, "A1")}


def stay_row(scheduled, admitted, discharge):
    return {"name": "R", "scheduled_date": scheduled, "admitted_datetime": admitted, "discharge_date": discharge,
            "creation": dt.datetime(2023, 4, 30, 7, 5, 1)}


def one_stay(spark, tables, **kwargs):
    records = spark.createDataFrame([("c", "R")], "claim string, inpatient_record string")
    return H.claim_stay(records, tables(inpatient_record=[stay_row(**kwargs)]), RUN).first()


def test_admission_classification(spark, tables):
    admitted = dt.datetime(2023, 5, 2, 9, 15)
    early = one_stay(spark, tables, scheduled=dt.date(2023, 5, 1), admitted=admitted, discharge=dt.date(2023, 5, 4))
    assert (early.patient_type_code, early.date_admitted, early.admitted_time) == ("IN", dt.date(2023, 5, 1), "07:05:01")
    assert (early.date_discharge, early.discharge_time) == (dt.date(2023, 5, 4), "12:30:00")
    late = one_stay(spark, tables, scheduled=dt.date(2023, 5, 3), admitted=admitted, discharge=dt.date(2023, 5, 2))
    assert (late.patient_type_code, late.date_admitted, late.admitted_time) == ("OUT", None, "09:15:00")
    assert (late.date_discharge, late.discharge_time) == (None, None)
    missing = one_stay(spark, tables, scheduled=None, admitted=admitted, discharge=None)
    assert (missing.patient_type_code, missing.date_discharge) == ("IN", None)
    today = one_stay(spark, tables, scheduled=dt.date(2023, 7, 1), admitted=dt.datetime(2023, 6, 1), discharge=None)
    assert today.patient_type_code == "OUT"


def test_disease_codes(spark):
    codes = spark.createDataFrame([("E119",), ("E11.9",), ("A01",), ("E11.901",), (None,), ("B5.1",)], "code string")
    got = {r[0]: r[1] for r in codes.select("code", disease_code("code")).collect()}
    assert got == {"E119": "E11.9", "E11.9": "E11.9", "A01": "A01", "E11.901": "E11", None: None, "B5.1": "B5.1"}


def test_folio_numbers_are_dense_and_go_on(table, spark):
    rows = [(f"c{i:03d}", "A" if i % 3 else "B", 2023, 5, T0) for i in range(60)]
    headers = spark.createDataFrame(rows, "name string, company string, claim_year int, claim_month int, creation timestamp_ntz")
    counters = table("folio_counter", {"company": "A", "claim_year": 2023, "claim_month": 5, "folio_no": 7},
                     {"company": "C", "claim_year": 2023, "claim_month": 5, "folio_no": 3})
    numbers, new = H.folio_numbers(headers, counters)
    got = {c: sorted(r.folio_no for r in numbers.collect() if r.company == c) for c in "AB"}
    assert got == {"A": list(range(8, 48)), "B": list(range(1, 21))}
    assert {(r.company, r.folio_no) for r in new.collect()} == {("A", 47), ("B", 20), ("C", 3)}


def test_links_go_to_the_latest_claim(table):
    claims = table("insurance_claim", claim("old", claim_appointment_list='["A1","A2"]'),
                   claim("new", patient_appointment="A2", creation=dt.datetime(2023, 5, 9)))
    appointments = table("patient_appointment", {"name": "A1"}, {"name": "A2", "nhif_patient_claim": "old"},
                         {"name": "A3", "nhif_patient_claim": "old"}, {"name": "A4", "nhif_patient_claim": "other"})
    got = {r.name: r.nhif_patient_claim for r in H.link_appointments(appointments, claims).collect()}
    assert got == {"A1": "old", "A2": "new", "A3": "", "A4": "other"}
    gone = {r.name: r.nhif_patient_claim
            for r in H.unlink_deleted_claims(appointments, table("insurance_claim", claim("old", patient_appointment="A2"))).collect()}
    assert gone == {"A1": None, "A2": "", "A3": "old", "A4": "other"}


def inpatient(tables):
    day1, day2 = dt.date(2023, 5, 1), dt.date(2023, 5, 2)
    visit = {"docstatus": 1, "duplicated": 0, "encounter_type": "Final", "appointment": "A1", "practitioner": "P",
             "creation": T0, "modified": T0}
    row = {"is_cancelled": 0, "prescribe": 0, "amount": 2.0, "modified": T0, "idx": 1}
    return tables(
        patient_appointment=[{"name": "A1", "billing_item": "I-visit", "paid_amount": 9.0, "creation": T0, "modified": T0}],
        patient_encounter=[
            {"name": "E1", "encounter_date": day1, "inpatient_record": "R", "insurance_subscription": "S",
             "insurance_company": "INS", **visit},
            {"name": "E2", "encounter_date": day2, **visit},
            {"name": "E3", "encounter_date": dt.date(2023, 5, 7), **visit},
        ],
        inpatient_record=[{"name": "R", "admission_encounter": "E1"}],
        inpatient_occupancy=[
            {"name": "O1", "parent": "R", "idx": 1, "check_in": dt.datetime(2023, 5, 1, 10), "service_unit": "W", "is_confirmed": 0, "modified": T0},
            {"name": "O2", "parent": "R", "idx": 2, "check_in": dt.datetime(2023, 5, 1, 18), "service_unit": "ICU", "is_confirmed": 1, "modified": T0},
            {"name": "O3", "parent": "R", "idx": 3, "check_in": dt.datetime(2023, 5, 2, 8), "service_unit": "ICU", "is_confirmed": 1, "modified": T0},
        ],
        inpatient_consultancy=[
            {"name": "V1", "parent": "R", "date": day1, "consultation_item": "Visit", "rate": 3.0, "is_confirmed": 1, "modified": T0},
            {"name": "V2", "parent": "R", "date": day2, "consultation_item": "Visit", "rate": 3.0, "is_confirmed": 1, "modified": T0},
            {"name": "V3", "parent": "R", "date": day1, "consultation_item": "Visit", "rate": 0.0, "is_confirmed": 1, "modified": T0},
        ],
        healthcare_service_unit=[{"name": "W", "service_unit_type": "Ward"}, {"name": "ICU", "service_unit_type": "Intensive"}],
        healthcare_service_unit_type=[{"name": "Ward", "item": "I-ward", "is_consultancy_chargeable": 1},
                                      {"name": "Intensive", "item": "I-icu", "is_consultancy_chargeable": 0}],
        item_rate=[{"item_code": "I-icu", "company": "CO", "insurance_subscription": "S", "insurance_company": "INS", "rate": r} for r in (80.0, 70.0)],
        lab_prescription=[{"name": f"L{i}", "parent": f"E{i}", "lab_test_code": "T", "lab_test_name": "Blood", **row} for i in (1, 2, 3)],
        item_template=[{"template_type": "Lab Test Template", "name": "T", "item": "I-lab"}],
    )


def test_inpatient_lines_follow_the_bed_days(tables, table):
    t = inpatient(tables)
    claims = table("insurance_claim", claim())
    lines = C.claim_lines(claims, t).collect()
    got = sorted((r.idx, r.ref_doctype, r.ref_docname, r.item_name, r.unit_price) for r in lines)
    assert got == [
        (2, "Inpatient Consultancy", "V1", "Visit", 3.0),
        (3, "Inpatient Occupancy", "O2", "ICU", 70.0),
        (4, "Inpatient Occupancy", "O3", "ICU", 70.0),
        (5, "Lab Prescription", "L1", "T", 2.0),
        (6, "Lab Prescription", "L2", "T", 2.0),
        (7, "Patient Appointment", "A1", "I-visit", 9.0),
    ]


def test_outpatient_quantity_and_consultation(tables, table):
    drug = {"parent": "E", "drug_code": "M", "amount": 2.0, "modified": T0, "idx": 1}
    t = tables(
        patient_appointment=[{"name": "A1", "billing_item": "I", "insurance_subscription": "S", "insurance_company": "X", "modified": T0}],
        patient_encounter=[{"name": "E", "appointment": "A1", "docstatus": 1, "creation": T0}],
        drug_prescription=[
            {"name": "D1", "quantity": 5.0, "quantity_returned": 2.0, **drug},
            {"name": "D2", "quantity": 4.0, "quantity_returned": 4.0, **drug},
            {"name": "D3", "quantity": None, "dn_detail": "N", **drug},
            {"name": "D4", "quantity": 1.0, "prescribe": 1, **drug},
        ],
    )
    claims = table("insurance_claim", claim())
    lines = {r.ref_docname: r for r in C.claim_lines(claims, t).collect()}
    assert {k: (r.item_quantity, r.amount_claimed, r.status) for k, r in lines.items()} == {
        "D1": (3.0, 6.0, "Draft"), "D2": (1.0, 2.0, "Draft"), "D3": (1.0, 2.0, "Submitted"), "A1": (1.0, None, None),
    }
    assert [r.detail for r in C.price_violations(C.claim_lines(claims, t)).collect()] == ["Patient Appointment A1 I"]


def item(name, **more):
    return {"name": name, "parent": "c", "item_code": "I", "item_name": "Item", "item_quantity": 1, "unit_price": 10.0,
            "amount_claimed": 10.0, "ref_doctype": "Drug Prescription", "status": "Draft", **more}


def test_reconcile(table):
    items = table(
        "claim_item",
        item("2", idx=2, ref_docname="a,b", patient_encounter="E2", approval_ref_no="Y", unit_price=5.0, amount_claimed=5.0, status="Submitted"),
        item("1", idx=1, ref_docname="c", patient_encounter="E1", approval_ref_no=""),
        item("3", idx=3, ref_docname="a,b", patient_encounter="E2", approval_ref_no="Z"),
        item("4", idx=4, item_code=None),
    )
    got = {r.item_code: r for r in M.reconcile_items(items).collect()}
    r = got["I"]
    assert (r.name, r.idx, r.item_quantity, r.unit_price, r.amount_claimed) == ("1", 1, 3, 10.0, 25.0)
    assert (r.approval_ref_no, r.ref_docname, r.patient_encounter, r.status) == ("Y,Z", "a,b,c", "E1,E2", "Submitted")
    assert {x.item_code: x.amount_claimed for x in M.reconcile_items(items, recompute_amount=True).collect()} == {"I": 30.0, None: 10.0}


def test_merge(table):
    claims = table("insurance_claim", claim("a"), claim("b", claim_appointment_list='["A3","A1"]'), claim("z", cardno="other"))
    merged = M.mergeable_claims(claims).first()
    assert (merged.claim, merged.claims, json.loads(merged.claim_appointment_list)) == ("a", 2, ["A1", "A3"])
    assert [r.claim for r in M.single_claim_violations(claims).collect()] == ["z"]


def test_missing_originals(table):
    originals = table("original_claim_item", item("o", ref_docname="a,b"), item("p"))
    items = table("claim_item", item("1", ref_docname="a"), item("2", ref_docname="a,b"), item("3"), item("4", ref_docname="a,x"))
    whole = M.missing_originals(items, originals)
    assert sorted(str(r.ref_docname) for r in whole.collect()) == ["None", "a,b", "a,x"]
    assert "name" not in whole.columns
    assert sorted(str(r.ref_docname) for r in M.missing_originals(items, originals, True).collect()) == ["None", "a,x"]


def test_changes(tables, table, spark):
    originals = table(
        "original_claim_item",
        item("1", idx=1, item_code="kept", ref_docname="k", amount_claimed=10.0),
        item("2", idx=2, item_code="gone", ref_docname="d1,d2,d3,d4,d5,k", patient_encounter="E9", item_name="Pill"),
        item("3", idx=3, item_code="again", ref_docname="d1"),
        item("4", idx=4, item_code="app", ref_docname="A1", ref_doctype="Patient Appointment"),
        item("5", idx=5, item_code="lab", ref_docname="l1,l2", ref_doctype="Lab Prescription"),
        item("6", idx=6, item_code="bed", ref_docname="o1,o2", ref_doctype="Inpatient Occupancy"),
        item("7", idx=7, item_code="other", ref_docname="q", ref_doctype="Something Else"),
    )
    items = table("claim_item", item("1", item_code="kept", ref_docname="k", amount_claimed=12.5))
    returned = {"parentfield": "drug_items", "parenttype": "LRPMT Returns", "encounter_no": "E1"}
    t = tables(
        drug_prescription=[{"name": "d1", "parent": "E1", "is_cancelled": 0}, {"name": "d2", "parent": "E1", "is_cancelled": 1},
                           {"name": "d3", "parent": "E1", "is_cancelled": 1}],
        medication_return=[{"child_name": "d2", "parent": "RET-2", **returned}, {"child_name": "d2", "parent": "RET-1", **returned}],
        medication_change_request=[{"name": "MC2", "patient_encounter": "E9"}, {"name": "MC1", "patient_encounter": "E9"}],
        medication_change_request_drug=[
            {"parent": m, "drug_name": "Pill", "parenttype": "Medication Change Request", "parentfield": "original_pharmacy_prescription"}
            for m in ("MC1", "MC2")
        ],
        lab_prescription=[{"name": "l1", "parent": "E2", "is_cancelled": 0}],
        inpatient_occupancy=[{"name": "o1", "is_confirmed": 0}],
    )
    headers = spark.createDataFrame([("c", 5, 2023, "CO", "A1")], "name string, claim_month int, claim_year int, company string, patient_appointment string")
    rows = G.track_changes(originals, items, headers, t, RUN).collect()
    got = {(r.status, r.ref_docname, r.patient_encounter, r.lrpmt_return, r.medication_change_request, r.amount_changed)
           for r in rows}
    assert len(rows) == 9
    assert got == {
            ("Amount Changed", "k", None, None, None, 2.5),
            ("Item Removed", "d1", "E1", None, None, 0.0),
            ("Item Cancelled", "d2", "E1", "RET-1", None, 0.0),
            ("Item Replaced", "d4", "E9", None, "MC1", 0.0),
            ("Item Replaced", "d5", "E9", None, "MC1", 0.0),
            ("Item Removed", "A1", None, None, None, 0.0),
            ("Item Removed", "l1", "E2", None, None, 0.0),
            ("Item Unconfirmed", "o1", None, None, None, 0.0),
            ("Item Removed", "o1,o2", None, None, None, 0.0),
    }
    assert {(r.claim_month, r.insurance_claim, r.posting_time) for r in rows} == {(5, "c", "12:30:00")}


def test_merge_and_card_checks(tables, table):
    app = {"patient": "PT", "appointment_date": dt.date(2023, 5, 1), "coverage_plan_card_number": "C", "coverage_plan_name": "Plan"}
    t = tables(patient_appointment=[{"name": "A1", "status": "Closed", **app}, {"name": "A2", **app}, {"name": "A3", "status": "Cancelled", **app}])
    held = {"workflow_state": "Unclaimable"}
    one = table("insurance_claim", claim("a", claim_appointment_list='["A1"]', **held))
    assert [(r.rule, r.detail) for r in V.merge_needed(one, t).collect()] == [("merge_appointments", "2")]
    assert V.card_decisions(one, t).first().decision == "Release"
    both = table("insurance_claim", claim("a", claim_appointment_list='["A1","A2"]', **held), claim("b", **held))
    assert {(r.claim, r.rule) for r in V.merge_needed(both, t).collect()} == {("a", "merge_claims"), ("b", "merge_claims")}
    assert {r.decision for r in V.card_decisions(both, t).collect()} == {"Hold"}


def test_total_is_compared_exactly(table):
    claims = table("insurance_claim", claim("c", total_amount=0.3), claim("d", total_amount=0.0), claim("e", total_amount=1.0))
    items = table("claim_item", item("1", amount_claimed=0.1), item("2", amount_claimed=0.2))
    assert [r.claim for r in V.total_violations(claims, items).collect()] == ["e"]


def test_folio_document(table, spark):
    headers = spark.createDataFrame(
        [("c1", " CARD ", "OUT", None), ("c2", None, "IN", dt.date(2023, 5, 1))],
        "name string, cardno string, patient_type_code string, date_admitted date",
    )
    for column in ("claim_year", "claim_month", "serial_no", "facility_code", "first_name", "last_name", "gender", "date_of_birth",
                   "patient_file_no", "authorization_no", "attendance_date", "practitioner_name", "practitioner_no", "item_crt_by",
                   "posting_date", "delayreason", "admitted_time", "date_discharge", "discharge_time"):
        headers = headers.withColumn(column, F.lit(None).cast("string"))
    lines = spark.createDataFrame(
        [("c1", 2, "B", 1.0, 2.0, 2.0, "", "P", None, "r2"), ("c1", 1, "A", 2.0, 1.5, 3.0, "AP", "P", dt.date(2023, 5, 2), "r1")],
        "claim string, idx int, item_code string, item_quantity double, unit_price double, amount_claimed double, "
        "approval_ref_no string, item_crt_by string, date_created date, ref_docname string",
    )
    diseases = spark.createDataFrame(
        [("c1", "Final", "E11.9", "P", None, "m")],
        "claim string, status string, disease_code string, item_crt_by string, date_created date, medical_code string",
    )
    notes = spark.createDataFrame([("c1", "note")], "claim string, clinical_notes string")
    numbers = spark.createDataFrame([("c1", 4)], "claim string, folio_no int")
    got = {r.claim: json.loads(r.folio_json)["entities"] for r in folio_documents(headers, diseases, lines, notes, numbers).collect()}
    (first,), (second,) = got["c1"], got["c2"]
    assert (first["CardNo"], first["FolioNo"], first["ClinicalNotes"], first["PatientFile"]) == ("CARD", 4, "note", "Stripped off")
    assert [(i["ItemCode"], i["ItemQuantity"], i["ApprovalRefNo"], i["DateCreated"]) for i in first["FolioItems"]] == [
        ("A", 2, "AP", "2023-05-02"), ("B", 1, None, "None")
    ]
    assert first["FolioDiseases"] == [{"Status": "Final", "DiseaseCode": "E11.9", "Remarks": None, "CreatedBy": "P", "DateCreated": "None"}]
    assert "DateAdmitted" not in first and second["DateAdmitted"] == "2023-05-01 None"
    assert second["FolioItems"] == [] and second["LateSubmissionReason"] is None
