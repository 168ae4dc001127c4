import datetime as dt

from wardledger.operators import delivery as L
from wardledger.operators import orders as O
from wardledger.operators import stock as S
from wardledger.options import RunContext

RUN = RunContext(dt.datetime(2023, 6, 1, 12, 30, 0))
T0 = dt.datetime(2023, 5, 1)


def test_order_lines_and_headers(tables):
    t = tables(
        patient_encounter=[
            {"name": "E1", "docstatus": 1, "company": "CO", "mode_of_payment": "Cash", "patient": "PT"},
            {"name": "E2", "docstatus": 1, "company": "CO", "inpatient_record": "R", "mode_of_payment": "Cash"},
            {"name": "E3", "docstatus": 1, "company": "??"},
            {"name": "E4", "docstatus": 1, "company": "CO2", "mode_of_payment": "Bare"},
        ],
        drug_prescription=[
            {"name": "D1", "parent": "E1", "drug_code": "M", "prescribe": 1, "quantity": 5.0, "quantity_returned": 1.0, "dosage": "2x1", "period": ""},
            {"name": "D2", "parent": "E1", "drug_code": "M", "prescribe": 0, "quantity": 5.0, "quantity_returned": 1.0},
            {"name": "D3", "parent": "E2", "drug_code": "M", "prescribe": 1},
            {"name": "D4", "parent": "E4", "drug_code": "M", "prescribe": 1},
        ],
        lab_prescription=[{"name": "L1", "parent": "E1", "lab_test_code": "T", "prescribe": 1, "is_cancelled": 1}],
        item_template=[{"template_type": "Medication", "name": "M", "item": "I"}],
        item=[{"item_code": "I", "item_name": "Pill", "description": "A pill"}],
        company_warehouse=[{"company": "CO", "warehouse": "W"}, {"company": "CO2", "warehouse": "W2"}],
        mode_of_payment=[{"name": "Cash", "price_list": ""}, {"name": "Bare"}],
        company=[{"name": "CO", "default_price_list": "Default"}],
        patient=[{"name": "PT", "customer": "CUST", "mobile": "07"}],
    )
    encounters = O.order_encounters(t)
    assert {r.name for r in encounters.collect()} == {"E1", "E3", "E4"}
    lines = O.order_lines(encounters, t, RUN)
    line = lines.filter("encounter = 'E1'").collect()
    assert [(r.reference_dn, r.category, r.item_name, r.qty, r.warehouse) for r in line] == [("D1", "drug", "Pill", 4.0, "W")]
    assert line[0].dosage_info == (
        "frequency: 2x1, <br>period: No Prescription Period, <br>dosage_form: , <br>interval: , <br>interval_uom: , "
        "<br>medical_code: No medical code, <br>Doctor's comment: Take medication as per dosage."
    )
    orders = O.order_headers(encounters, lines, t, RUN).collect()
    assert [(r.encounter, r.category, r.price_list, r.customer) for r in orders] == [("E1", "drug", "Default", "CUST")]
    assert {(r.encounter, r.rule) for r in O.order_violations(encounters, lines, t).collect()} == {
        ("E3", "unknown_warehouse"), ("E4", "no_price_list")
    }


def ledger(name, qty, when=T0, cancelled=0):
    return {"name": name, "item_code": "I", "warehouse": "W", "qty_after_transaction": qty, "is_cancelled": cancelled, "creation": when}


def test_latest_ledger_entry(tables):
    later = dt.datetime(2023, 5, 2)
    assert S.stock_on_hand(tables(stock_ledger_entry=[ledger("a", 5.0), ledger("b", 7.0)])).first().actual_qty == 7.0
    assert S.stock_on_hand(tables(stock_ledger_entry=[ledger("a", 5.0), ledger("b", None, later)])).first().actual_qty == 0.0
    assert S.stock_on_hand(tables(stock_ledger_entry=[ledger("a", 5.0), ledger("b", 9.0, later, 1)])).first().actual_qty == 5.0


def test_order_checks(tables):
    t = tables(
        stock_ledger_entry=[ledger("a", 5.0)],
        item=[{"item_code": "I", "is_stock_item": 1}, {"item_code": "S", "is_stock_item": 0}],
        sales_order=[{"name": "SO", "set_warehouse": "W"}],
        sales_order_item=[
            {"parent": "SO", "idx": 1, "item_code": "I", "qty": 5.0}, {"parent": "SO", "idx": 2, "item_code": "I", "qty": 6.0},
            {"parent": "SO", "idx": 3, "item_code": "S", "qty": 1.0, "reference_dt": "Drug Prescription"},
            {"parent": "SO", "idx": 4, "item_code": "unknown", "qty": 1.0, "reference_dt": "Drug Prescription"},
        ],
    )
    assert {(r.idx, r.rule, r.severity) for r in S.order_stock_checks(t, "validate").collect()} == {
        (2, "shortage", "warn"), (3, "not_a_stock_item", "warn"), (4, "not_a_stock_item", "warn")
    }
    assert {(r.idx, r.rule, r.severity) for r in S.order_stock_checks(t, "before_submit").collect()} == {(2, "shortage", "error")}
    filled = {r.idx: r for r in O.with_dosage_template(t.sales_order_item, t).collect()}
    assert filled[1].reference_dt == "Drug Prescription" and filled[1].dosage_info.count("\n") == 5
    assert filled[3].dosage_info is None


def test_invoice_checks_and_dimensions(tables):
    t = tables(
        item=[{"item_code": "I", "is_stock_item": 1}],
        sales_invoice=[{"name": "S1", "enabled_auto_create_delivery_notes": 1}, {"name": "S2", "enabled_auto_create_delivery_notes": 0},
                       {"name": "S3", "enabled_auto_create_delivery_notes": 1}],
        sales_invoice_item=[
            {"name": "x", "parent": "S1", "idx": 2, "item_code": "I", "qty": 1.0, "department": "", "healthcare_practitioner": "P9"},
            {"name": "y", "parent": "S1", "idx": 1, "item_code": "I", "qty": 1.0, "sales_order": "SO", "reference_dt": "Drug Prescription"},
            {"name": "z", "parent": "S2", "idx": 1, "item_code": "I", "qty": 1.0, "sales_order": "SO", "reference_dt": "Drug Prescription"},
            {"name": "w", "parent": "S3", "idx": 1, "item_code": "I", "qty": 1.0},
        ],
        sales_order=[{"name": "SO", "healthcare_practitioner": "P1", "department": "D1"}],
    )
    assert {(r.parent, r.idx) for r in S.invoice_stock_checks(t, "validate").collect()} == {("S1", 1), ("S1", 2)}
    assert {(r.parent, r.idx) for r in S.invoice_stock_checks(t, "before_submit").collect()} == {("S1", 1), ("S1", 2), ("S3", 1)}
    filled = {r.name: (r.healthcare_practitioner, r.department) for r in S.with_order_dimensions(t).collect()}
    assert filled == {"x": ("P9", "D1"), "y": ("P1", "D1"), "z": ("P1", "D1"), "w": (None, None)}


def test_dosage_text_forms(spark):
    one_line = "frequency: 2x1, <br>period: 3 days"
    lines = "frequency: 1 x 1, \nperiod: \n5 days, \ninterval: 8\nDoctor's comment: after food"
    rows = spark.createDataFrame([(1, one_line), (2, lines), (3, None), (4, "interval_uom: Hour")], "id int, description string")
    got = {r.id: r for r in L.parsed_dosage(rows).collect()}
    assert (got[1].dosage, got[1].period) == ("2x1, <br>period: 3 days", "3 days")
    assert (got[2].dosage, got[2].period, got[2].interval, got[2].comment) == ("1 x 1, ", "5 days, ", "8", "after food")
    assert (got[3].dosage, got[4].interval, got[4].interval_uom) == (None, None, "Hour")


def test_dispensing(tables):
    note = {"company": "CO", "patient": "PT", "form_sales_invoice": "SI", "set_warehouse": "W"}
    t = tables(
        delivery_note=[{"name": "N1", "reference_name": "E1", **note}, {"name": "N2", "reference_name": "E2", **note},
                       {"name": "N3", "reference_name": "E3", **note}, {"name": "N4", "reference_name": "E1", **note}],
        delivery_note_item=[
            {"name": "i1", "parent": "N1", "item_code": "I1", "qty": 2.0, "rate": 5.0, "description": "frequency: 3x1"},
            {"name": "i2", "parent": "N1", "item_code": "I2", "qty": 1.0, "rate": 1.0, "reference_name": "E1"},
            {"name": "i3", "parent": "N2", "item_code": "none"}, {"name": "i4", "parent": "N3", "item_code": "I1"},
            {"name": "i5", "parent": "N4", "item_code": "I2", "reference_name": "E1"},
        ],
        medication=[{"name": "M1", "item": "I1", "medication_name": "Pill", "default_prescription_duration": "a week"},
                    {"name": "M0", "item": "I1", "medication_name": "First", "default_prescription_duration": "a day"}, {"name": "M2", "item": "I2"}],
        codification_table=[
            {"name": "k2", "parent": e, "parenttype": "Patient Encounter", "parentfield": "patient_encounter_final_diagnosis", "idx": 2, "medical_code": "Z"} for e in ("E1", "E2")
        ] + [{"name": "k1", "parent": "E1", "parenttype": "Patient Encounter", "parentfield": "patient_encounter_final_diagnosis", "idx": 1, "medical_code": "A", "description": "Aches"}],
        healthcare_service_unit=[{"name": n, "company": "CO", "warehouse": "W", "service_unit_type": "Pharmacy"} for n in ("U2", "U1")],
        drug_prescription=[
            {"name": "d1", "parent": "E1", "drug_code": "M0", "prescribe": 1}, {"name": "d2", "parent": "E1", "drug_code": "M2", "prescribe": 1},
            {"name": "d3", "parent": "E1", "drug_code": "M9", "prescribe": 1}, {"name": "d4", "parent": "E1", "drug_code": "M9", "prescribe": 0},
            {"name": "d5", "parent": "E2", "drug_code": "M9", "prescribe": 1},
        ],
    )
    assert {(r.note, r.rule) for r in L.dispensing_violations(t).collect()} == {("N2", "no_medication"), ("N3", "no_final_diagnosis")}
    new = L.dispensed_prescriptions(L.accepted_items(t), t).collect()
    assert [(r.parent, r.drug_code, r.medical_code, r.dosage, r.period, r.quantity, r.healthcare_service_unit) for r in new] == [
        ("E1", "M0", "A\nAches", "3x1", "a day", 2.0, "U1")
    ]
    names = {r.name for r in L.updated_prescriptions(t).collect()}
    # N1 delivers M0 and M2, N4 only M2, so d1, d3 and the new row of N1 go; the refused note of E2 removes nothing.
    assert names == {"d2", "d4", "d5"}
