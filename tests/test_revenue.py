import datetime as dt

import pytest

from wardledger.operators import revenue as R
from wardledger.options import ReportFilters
from wardledger.plans.revenue_report import report_with_total, revenue_report
from wardledger.sources.schemas import REVENUE

DAY = dt.date(2023, 2, 10)
ALL = ReportFilters(dt.date(2023, 1, 1), dt.date(2023, 12, 31), "A")


def encounter(**more):
    return {"name": "E1", "practitioner": "P", "encounter_date": DAY, "company": "A", "docstatus": 1,
            "healthcare_service_unit": "U", "insurance_coverage_plan": "Plan", **more}


def lab(name, **more):
    return {"name": name, "parent": "E1", "department_hsu": "D", "amount": 10.0, "is_not_available_inhouse": 0,
            "is_cancelled": 0, "prescribe": 0, **more}


PRACTITIONER = [{"name": "P", "healthcare_practitioner_type": "Resident", "department": "Surgery"}]


def test_drafts_stay_apart_by_raw_status(tables):
    t = tables(
        healthcare_practitioner=PRACTITIONER,
        patient_encounter=[encounter()],
        lab_prescription=[lab("L1"), lab("L2", lab_test="T0"), lab("L3", lab_test="T1"), lab("L4", lab_test="T2"),
                          lab("L5", lab_test="T1"), lab("L6", lab_test="gone"), lab("L7", lab_test="")],
        lab_test=[{"name": "T0", "docstatus": 0}, {"name": "T1", "docstatus": 1}, {"name": "T2", "docstatus": 2}],
    )
    rows = R.lab_revenue(t, ALL).collect()
    assert sorted((r.status, r.amount) for r in rows) == [
        ("Draft", 10.0), ("Draft", 10.0), ("Draft", 30.0), ("Submitted", 20.0)
    ]
    assert {(r.year, r.month, r.department) for r in rows} == {(2023, "February", "Lab")}


def test_draft_encounters_count_only_without_company(tables):
    t = tables(
        healthcare_practitioner=PRACTITIONER,
        patient_encounter=[encounter(docstatus=0)],
        lab_prescription=[lab("L1")],
    )
    assert R.lab_revenue(t, ALL).count() == 0
    assert R.lab_revenue(t, ReportFilters(from_date=DAY, to_date=DAY)).count() == 1


def test_drug_amount_and_flag(tables):
    drug = {"healthcare_service_unit": "Store", "quantity_returned": 1.0}
    t = tables(
        healthcare_practitioner=PRACTITIONER,
        patient_encounter=[encounter()],
        drug_prescription=[
            lab("D1", quantity=3.0, **drug), lab("D2", quantity=None, **drug),
            lab("D3", quantity=2.0, dn_detail="", **drug),
        ],
    )
    rows = R.drug_revenue(t, ALL).collect()
    assert sorted((r.status, r.amount) for r in rows) == [("Draft", 20.0), ("Submitted", 10.0)]


def appointment(**more):
    return {"name": "A1", "practitioner": "P", "appointment_date": DAY, "company": "A", "status": "Closed",
            "insurance_subscription": "S", "follow_up": 0, "paid_amount": 5.0, "service_unit": "U",
            "coverage_plan_name": "Plan", **more}


def test_consultations_need_a_subscription(tables):
    t = tables(
        healthcare_practitioner=PRACTITIONER,
        patient_appointment=[appointment(), appointment(name="A2", insurance_subscription=""),
                             appointment(name="A3", insurance_subscription=None), appointment(name="A4", follow_up=1),
                             appointment(name="A5", practitioner="nobody")],
    )
    assert [(r.amount, r.main_department) for r in R.consultation_revenue(t, ALL).collect()] == [(5.0, None)]


def stay(**more):
    return {"name": "R1", "patient_appointment": "A1", "company": "A", "insurance_subscription": "S",
            "admitted_datetime": dt.datetime(2023, 1, 31, 23, 0), **more}


def test_beds_group_by_admission_and_show_earliest_check_in(tables):
    bed = {"parent": "R1", "service_unit": "W", "is_confirmed": 1, "amount": 7.0}
    t = tables(
        patient_appointment=[appointment()],
        inpatient_record=[stay()],
        healthcare_service_unit=[{"name": "W", "service_unit_type": "Ward"}],
        healthcare_service_unit_type=[{"name": "Ward", "item_group": "Beds"}],
        inpatient_occupancy=[
            {"name": "O1", "check_in": dt.datetime(2023, 1, 31, 23, 30), **bed},
            {"name": "O2", "check_in": dt.datetime(2023, 2, 1, 9, 0), **bed},
            {"name": "O3", "check_in": dt.datetime(2023, 12, 31, 23, 59), **bed},
            {"name": "O4", "check_in": dt.datetime(2024, 1, 1, 0, 0), **bed},
        ],
    )
    rows = R.bed_revenue(t, ALL).collect()
    assert [(r.year, r.month, r.amount, r.speciality) for r in rows] == [(2023, "January", 21.0, "Beds")]


def test_items_of_the_same_name_multiply_consultancies(tables):
    t = tables(
        patient_appointment=[appointment()],
        inpatient_record=[stay()],
        item=[{"item_code": "I1", "item_name": "Visit", "item_group": "G"},
              {"item_code": "I2", "item_name": "Visit", "item_group": "G"},
              {"item_code": "I3", "item_name": "Visit", "item_group": "H"}],
        inpatient_consultancy=[{"name": "C1", "parent": "R1", "date": DAY, "consultation_item": "Visit", "rate": 4.0,
                                "is_confirmed": 1, "encounter": None}],
    )
    rows = R.consultancy_revenue(t, ALL).collect()
    assert sorted((r.speciality, r.amount, r.healthcare_practitioner) for r in rows) == [("G", 8.0, None), ("H", 4.0, None)]


def test_inpatient_branches_need_all_filters(tables):
    with pytest.raises(ValueError):
        R.bed_revenue(tables(), ReportFilters(company="A"))


def test_total_of_repeated_rows_and_of_none(spark):
    row = {f.name: None for f in REVENUE.fields} | {"year": 2023, "department": "Lab", "status": "Draft", "amount": 0.1}
    blank = dict.fromkeys(REVENUE.names)
    report = spark.createDataFrame([row, row, row | {"amount": 0.2}, row | {"amount": None}, blank], REVENUE)
    found = sorted(((r.department, r.year, r.amount) for r in report_with_total(report).collect()), key=str)
    lab = [("Lab", 2023, 0.1), ("Lab", 2023, 0.1), ("Lab", 2023, 0.2), ("Lab", 2023, None)]
    assert found == sorted([*lab, (None, None, None), ("Total", None, 0.4)], key=str)
    (total,) = report_with_total(report.limit(0)).collect()
    assert total.asDict() == blank | {"department": "Total"}


def test_total_costs_one_exchange_and_no_second_pass(tables):
    report = revenue_report(tables(), ALL, include_cash=True)

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(report_with_total(report)) <= exchanges(report) + 1


def test_total_is_the_sum_of_the_branches(tables):
    t = tables(
        healthcare_practitioner=PRACTITIONER,
        patient_encounter=[encounter()],
        patient_appointment=[appointment()],
        lab_prescription=[lab("L1")],
        therapy_plan_detail=[lab("T1")],
        sales_invoice=[{"name": "SI", "company": "A", "posting_date": DAY, "is_pos": 1}],
        sales_invoice_item=[{"parent": "SI", "docstatus": 1, "amount": 3.0, "item_group": "X"}],
    )
    rows = report_with_total(revenue_report(t, ALL, include_cash=True)).collect()
    total = [r.amount for r in rows if r.department == "Total"]
    assert total == [28.0] == [sum(r.amount for r in rows if r.department != "Total")]
