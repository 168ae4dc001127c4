"""Checking SQL of the revenue report."""

STEPS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

_RANGE = "BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"

STEPS["hp"] = """
SELECT p.name AS practitioner, p.healthcare_practitioner_type, p.department AS speciality, d.main_department
FROM healthcare_practitioner p LEFT JOIN medical_department d ON p.department = d.name"""

QUERIES["r1_consultation_revenue"] = f"""
SELECT CAST(year(a.appointment_date) AS int) AS year, strftime(min(a.appointment_date), '%B') AS month,
       a.practitioner AS healthcare_practitioner, hp.healthcare_practitioner_type,
       a.service_unit AS practitioner_hsu, a.service_unit AS department_hsu,
       CAST(sum(CAST(a.paid_amount AS decimal(18,4))) AS double) AS amount, 'Consultation' AS department,
       a.coverage_plan_name AS payment_mode, hp.speciality, hp.main_department, 'Submitted' AS status
FROM patient_appointment a JOIN hp ON a.practitioner = hp.practitioner
WHERE a.status = 'Closed' AND a.insurance_subscription <> '' AND a.follow_up = 0
  AND a.company = 'CO-0' AND a.appointment_date {_RANGE}
GROUP BY year(a.appointment_date), month(a.appointment_date), a.practitioner, hp.healthcare_practitioner_type,
         a.service_unit, a.coverage_plan_name, hp.speciality, hp.main_department"""


def _prescription(label, table, unit, amount, join, status, key, where):
    return f"""
SELECT CAST(year(e.encounter_date) AS int) AS year, strftime(min(e.encounter_date), '%B') AS month,
       e.practitioner AS healthcare_practitioner, hp.healthcare_practitioner_type,
       e.healthcare_service_unit AS practitioner_hsu, x.{unit} AS department_hsu,
       CAST(sum(CAST({amount} AS decimal(18,4))) AS double) AS amount, '{label}' AS department,
       e.insurance_coverage_plan AS payment_mode, hp.speciality, hp.main_department, {status} AS status
FROM {table} x JOIN patient_encounter e ON x.parent = e.name JOIN hp ON e.practitioner = hp.practitioner {join}
WHERE x.is_not_available_inhouse = 0 AND x.is_cancelled = 0 AND x.prescribe = 0 AND {where}
GROUP BY year(e.encounter_date), month(e.encounter_date), e.practitioner, hp.healthcare_practitioner_type,
         e.healthcare_service_unit, x.{unit}, e.insurance_coverage_plan, hp.speciality, hp.main_department, {key}"""


_COMPANY = f"e.encounter_date {_RANGE} AND e.company = 'CO-0' AND e.docstatus = 1"
_OPEN = "e.encounter_date >= DATE '1997-01-01'"


def _documented(label, table, field, document, where=_COMPANY):
    return _prescription(
        label, table, "department_hsu", "x.amount", f"LEFT JOIN {document} d ON x.{field} = d.name",
        "CASE WHEN d.docstatus = 1 THEN 'Submitted' ELSE 'Draft' END", "d.docstatus", where,
    )


def _drug(where=_COMPANY):
    return _prescription(
        "Medication", "drug_prescription", "healthcare_service_unit",
        "x.amount * (x.quantity - x.quantity_returned)", "",
        "CASE WHEN x.dn_detail IS NULL THEN 'Draft' ELSE 'Submitted' END", "x.dn_detail IS NULL", where,
    )


def _therapy(where=_COMPANY):
    return _prescription(
        "Therapy", "therapy_plan_detail", "department_hsu", "x.amount", "", "'Submitted'",
        "x.is_cancelled", where,
    )


_LAB = ("Lab", "lab_prescription", "lab_test", "lab_test")
_RAD = ("Radiology", "radiology_prescription", "radiology_examination", "radiology_examination")
_PROC = ("Clinical Procedure", "procedure_prescription", "clinical_procedure", "clinical_procedure")

QUERIES["r2_lab_revenue"] = _documented(*_LAB)
QUERIES["r3_radiology_revenue"] = _documented(*_RAD)
QUERIES["r4_procedure_revenue"] = _documented(*_PROC)
QUERIES["r5_drug_revenue"] = _drug()
QUERIES["r6_therapy_revenue"] = _therapy()

QUERIES["r7_bed_revenue"] = f"""
SELECT CAST(year(min(o.check_in)) AS int) AS year, strftime(min(o.check_in), '%B') AS month,
       CAST(NULL AS varchar) AS healthcare_practitioner, CAST(NULL AS varchar) AS healthcare_practitioner_type,
       CAST(NULL AS varchar) AS practitioner_hsu, o.service_unit AS department_hsu,
       CAST(sum(CAST(o.amount AS decimal(18,4))) AS double) AS amount, 'IPD' AS department,
       a.coverage_plan_name AS payment_mode, ut.item_group AS speciality,
       CAST(NULL AS varchar) AS main_department, 'Confirmed' AS status
FROM inpatient_occupancy o JOIN inpatient_record r ON o.parent = r.name
JOIN healthcare_service_unit u ON o.service_unit = u.name
JOIN healthcare_service_unit_type ut ON u.service_unit_type = ut.name
JOIN patient_appointment a ON r.patient_appointment = a.name
WHERE o.is_confirmed = 1 AND CAST(o.check_in AS date) {_RANGE} AND r.company = 'CO-0' AND r.insurance_subscription <> ''
GROUP BY year(r.admitted_datetime), month(r.admitted_datetime), o.service_unit, ut.item_group, a.coverage_plan_name"""

QUERIES["r8_consultancy_revenue"] = f"""
SELECT CAST(year(min(c.date)) AS int) AS year, strftime(min(c.date), '%B') AS month,
       e.practitioner AS healthcare_practitioner, p.healthcare_practitioner_type,
       e.healthcare_service_unit AS practitioner_hsu, CAST(NULL AS varchar) AS department_hsu,
       CAST(sum(CAST(c.rate AS decimal(18,4))) AS double) AS amount, 'IPD' AS department,
       a.coverage_plan_name AS payment_mode, i.item_group AS speciality,
       CAST(NULL AS varchar) AS main_department, 'Confirmed' AS status
FROM inpatient_consultancy c JOIN inpatient_record r ON c.parent = r.name
JOIN patient_appointment a ON r.patient_appointment = a.name JOIN item i ON c.consultation_item = i.item_name
LEFT JOIN patient_encounter e ON c.encounter = e.name LEFT JOIN healthcare_practitioner p ON e.practitioner = p.name
WHERE c.is_confirmed = 1 AND c.date {_RANGE} AND r.company = 'CO-0' AND r.insurance_subscription <> ''
GROUP BY year(r.admitted_datetime), month(r.admitted_datetime), e.practitioner, p.healthcare_practitioner_type,
         i.item_group, e.healthcare_service_unit, a.coverage_plan_name"""

QUERIES["r9_report_filters"] = " UNION ALL ".join(
    [_documented(*k, where=_OPEN) for k in (_LAB, _RAD, _PROC)] + [_drug(_OPEN), _therapy(_OPEN)]
)


def _cash(where):
    return f"""
SELECT CAST(year(i.posting_date) AS int) AS year, strftime(min(i.posting_date), '%B') AS month,
       x.healthcare_practitioner, CAST(NULL AS varchar) AS healthcare_practitioner_type,
       CAST(NULL AS varchar) AS practitioner_hsu, x.healthcare_service_unit AS department_hsu,
       CAST(sum(CAST(x.amount AS decimal(18,4))) AS double) AS amount, x.item_group AS department,
       'Cash' AS payment_mode, CAST(NULL AS varchar) AS speciality, CAST(NULL AS varchar) AS main_department,
       'Submitted' AS status
FROM sales_invoice_item x JOIN sales_invoice i ON x.parent = i.name
WHERE {where} AND x.docstatus = 1 AND i.posting_date {_RANGE} AND i.company = 'CO-0'
GROUP BY year(i.posting_date), month(i.posting_date), x.healthcare_practitioner, x.healthcare_service_unit, x.item_group"""


QUERIES["r12_cash_revenue"] = f"{_cash('i.is_pos = 1')} UNION ALL {_cash('''i.is_pos = 0 AND i.patient <> \'\'''')}"

STEPS["report_rows"] = " UNION ALL ".join(
    QUERIES[k]
    for k in (
        "r1_consultation_revenue", "r2_lab_revenue", "r3_radiology_revenue", "r4_procedure_revenue",
        "r5_drug_revenue", "r6_therapy_revenue", "r7_bed_revenue", "r8_consultancy_revenue",
    )
)
QUERIES["r10_revenue_report"] = "SELECT * FROM report_rows"
QUERIES["r10_report_with_cash"] = f"SELECT * FROM report_rows UNION ALL {QUERIES['r12_cash_revenue']}"
QUERIES["r11_report_total"] = """
SELECT * FROM report_rows UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, CAST(sum(CAST(amount AS decimal(18,4))) AS double), 'Total',
       NULL, NULL, NULL, NULL FROM report_rows"""
