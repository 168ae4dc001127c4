"""Checking SQL of the claim's diseases and items."""

STEPS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

_CODE = """CASE WHEN instr(code, '.') = 0 AND length(code) > 3 THEN code[1:3] || '.' || code[4:4]
            WHEN instr(code, '.') > 0 AND length(code) <= 5 THEN code ELSE code[1:3] END"""

STEPS["disease_rows"] = f"""
SELECT claim, CASE WHEN final THEN 'Final Diagnosis' ELSE 'Provisional Diagnosis' END AS diagnosis_type,
       CASE WHEN final THEN 'Final' ELSE 'Provisional' END AS status, encounter AS patient_encounter,
       name AS codification_table, medical_code, {_CODE} AS disease_code, description[1:139] AS description,
       practitioner AS item_crt_by, CAST(modified AS date) AS date_created
FROM (SELECT e.claim, t.*, e.encounter, e.practitioner, t.parentfield = 'patient_encounter_final_diagnosis' AS final,
             row_number() OVER (PARTITION BY e.claim, t.parentfield, t.medical_code ORDER BY t.modified, t.name) AS rn
      FROM claim_enc e JOIN codification_table t ON t.parent = e.encounter AND t.parenttype = 'Patient Encounter') WHERE rn = 1"""
QUERIES["c1_claim_diseases"] = "SELECT * REPLACE (CAST(date_created AS varchar) AS date_created) FROM disease_rows"
QUERIES["c2_disease_codes"] = f"SELECT DISTINCT code, {_CODE} AS disease_code FROM codification_table"
QUERIES["c2_missing_codes"] = """
SELECT e.claim, 'disease_code' AS rule, t.name AS detail
FROM claim_enc e JOIN codification_table t ON t.parent = e.encounter WHERE t.code IS NULL"""


def _rx(order, doctype, template_type, table, template, label, doc_type, doc, quantity):
    q = "quantity, quantity_returned" if quantity else "CAST(NULL AS double) AS quantity, CAST(NULL AS double) AS quantity_returned"
    d = ("dosage, period, dosage_form, interval, interval_uom, medical_code, comment" if quantity else
         ", ".join(f"CAST(NULL AS varchar) AS {c}" for c in
                   "dosage period dosage_form interval interval_uom medical_code comment".split()))
    return f"""
SELECT {order} AS table_order, '{doctype}' AS ref_doctype, '{template_type}' AS template_type, {template} AS template,
       {label} AS display_name, name, parent, idx, amount, {q}, prescribe, is_cancelled, is_not_available_inhouse,
       {doc_type} AS document_type, {doc} AS document, modified, {d} FROM {table}"""


STEPS["rx"] = " UNION ALL ".join(
    [
        _rx(0, "Lab Prescription", "Lab Test Template", "lab_prescription", "lab_test_code", "lab_test_name",
            "'Lab Test'", "lab_test", False),
        _rx(1, "Radiology Procedure Prescription", "Radiology Examination Template", "radiology_prescription",
            "radiology_examination_template", "radiology_procedure_name", "'Radiology Examination'",
            "radiology_examination", False),
        _rx(2, "Procedure Prescription", "Clinical Procedure Template", "procedure_prescription", "procedure",
            "procedure_name", "'Clinical Procedure'", "clinical_procedure", False),
        _rx(3, "Drug Prescription", "Medication", "drug_prescription", "drug_code", "drug_name",
            "'Delivery Note Item'", "dn_detail", True),
        _rx(4, "Therapy Plan Detail", "Therapy Type", "therapy_plan_detail", "therapy_type", "therapy_type",
            "NULL", "NULL", False),
    ]
)
QUERIES["c3_prescriptions"] = "SELECT * REPLACE (CAST(modified AS varchar) AS modified) FROM rx"

STEPS["rx_status"] = """
SELECT x.*, CASE WHEN x.ref_doctype = 'Therapy Plan Detail' OR x.document <> '' THEN 'Submitted'
                 WHEN x.ref_doctype = 'Lab Prescription' AND l.workflow_state <> '' AND l.workflow_state <> 'Lab Test Requested'
                 THEN 'Submitted' ELSE 'Draft' END AS status
FROM rx x LEFT JOIN lab_test l ON l.ref_docname = x.parent AND l.ref_doctype = 'Patient Encounter' AND l.ref_childname = x.name"""
QUERIES["c7_item_status"] = "SELECT name, ref_doctype, status FROM rx_status"

STEPS["rx_line"] = """
SELECT s.*, i.item AS item_code, a.approval_number AS approval_ref_no,
       CASE WHEN coalesce(s.quantity, 0) - coalesce(s.quantity_returned, 0) = 0 THEN 1.0
            ELSE coalesce(s.quantity, 0) - coalesce(s.quantity_returned, 0) END AS delivered
FROM rx_status s LEFT JOIN item_template i ON i.template_type = s.template_type AND i.name = s.template
LEFT JOIN approval a ON a.ref_doctype = s.document_type AND a.ref_docname = s.document AND s.document <> ''
WHERE s.prescribe = 0 AND s.is_cancelled = 0"""


def _service(source, label):
    return f"""
SELECT e.claim, x.{label} AS item_name, x.item_code, x.delivered AS item_quantity, x.amount AS unit_price,
       x.amount * x.delivered AS amount_claimed, x.approval_ref_no, x.status, x.parent AS patient_encounter, x.ref_doctype,
       x.name AS ref_docname, CAST(x.modified AS date) AS date_created, e.practitioner AS item_crt_by,
       e.creation AS encounter_creation, x.table_order, x.idx AS row_idx
FROM {source} e JOIN rx_line x ON x.parent = e.encounter"""


STEPS["out_enc"] = "SELECT * FROM claim_enc WHERE claim NOT IN (SELECT claim FROM claim_record)"
STEPS["out_line"] = _service("out_enc", "display_name")
STEPS["in_claim"] = """
SELECT r.claim, r.inpatient_record, i.admission_encounter, c.patient_appointment, c.company
FROM claim_record r JOIN inpatient_record i ON r.inpatient_record = i.name JOIN insurance_claim c ON c.name = r.claim"""
STEPS["unit_type"] = """
SELECT u.name AS service_unit, ut.item AS item_code, ut.is_consultancy_chargeable
FROM healthcare_service_unit u JOIN healthcare_service_unit_type ut ON u.service_unit_type = ut.name"""
STEPS["stay_day"] = """
SELECT * FROM (SELECT parent AS inpatient_record, CAST(check_in AS date) AS day, service_unit, idx AS position,
  row_number() OVER (PARTITION BY parent, CAST(check_in AS date) ORDER BY idx, name) AS rn FROM inpatient_occupancy) WHERE rn = 1"""
STEPS["in_enc"] = """
SELECT e.*, d.position FROM claim_enc e JOIN in_claim s ON s.claim = e.claim
JOIN stay_day d ON d.inpatient_record = s.inpatient_record AND d.day = e.encounter_date"""
_TIES = "CAST(NULL AS timestamp) AS encounter_creation, CAST(NULL AS int) AS table_order"
STEPS["admission_line"] = f"""
SELECT s.claim, a.billing_item AS item_name, a.billing_item AS item_code, 1.0 AS item_quantity, a.paid_amount AS unit_price,
       a.paid_amount AS amount_claimed, '' AS approval_ref_no, CAST(NULL AS varchar) AS status,
       s.admission_encounter AS patient_encounter, 'Patient Appointment' AS ref_doctype, a.name AS ref_docname,
       CAST(a.creation AS date) AS date_created, a.practitioner AS item_crt_by, {_TIES}, CAST(NULL AS int) AS row_idx
FROM in_claim s JOIN patient_appointment a ON a.name = s.patient_appointment"""
STEPS["bed_line"] = f"""
SELECT s.claim, o.service_unit AS item_name, u.item_code, 1.0 AS item_quantity, r.rate AS unit_price, r.rate AS amount_claimed,
       '' AS approval_ref_no, CAST(NULL AS varchar) AS status, s.admission_encounter AS patient_encounter,
       'Inpatient Occupancy' AS ref_doctype, o.name AS ref_docname, CAST(o.modified AS date) AS date_created,
       o.modified_by AS item_crt_by, {_TIES}, o.idx AS row_idx
FROM in_claim s JOIN inpatient_occupancy o ON o.parent = s.inpatient_record AND o.is_confirmed = 1
LEFT JOIN unit_type u ON u.service_unit = o.service_unit LEFT JOIN patient_encounter e ON e.name = s.admission_encounter
LEFT JOIN item_rate r ON r.item_code = u.item_code AND r.company = s.company
  AND r.insurance_subscription = e.insurance_subscription AND r.insurance_company = e.insurance_company"""
STEPS["in_service_line"] = _service("in_enc", "template")
STEPS["in_consult_line"] = f"""
SELECT s.claim, c.consultation_item AS item_name, c.consultation_item AS item_code, 1.0 AS item_quantity,
       c.rate AS unit_price, c.rate AS amount_claimed, '' AS approval_ref_no, CAST(NULL AS varchar) AS status,
       coalesce(nullif(c.encounter, ''), s.admission_encounter) AS patient_encounter,
       'Inpatient Consultancy' AS ref_doctype, c.name AS ref_docname, CAST(c.modified AS date) AS date_created,
       c.healthcare_practitioner AS item_crt_by, {_TIES}, c.idx AS row_idx
FROM in_claim s JOIN stay_day d ON d.inpatient_record = s.inpatient_record
JOIN unit_type u ON u.service_unit = d.service_unit AND u.is_consultancy_chargeable = 1
JOIN inpatient_consultancy c ON c.parent = s.inpatient_record AND c.date = d.day AND c.is_confirmed = 1 AND c.rate <> 0"""
STEPS["in_line"] = """
SELECT * FROM admission_line UNION ALL SELECT * FROM bed_line UNION ALL SELECT * FROM in_service_line
UNION ALL SELECT * FROM in_consult_line"""
STEPS["consult_line"] = f"""
SELECT k.claim, a.billing_item AS item_name, a.billing_item AS item_code, 1.0 AS item_quantity, r.rate AS unit_price,
       r.rate AS amount_claimed, '' AS approval_ref_no, CAST(NULL AS varchar) AS status,
       CAST(NULL AS varchar) AS patient_encounter, 'Patient Appointment' AS ref_doctype, a.name AS ref_docname,
       CAST(a.modified AS date) AS date_created, a.practitioner AS item_crt_by, {_TIES}, k.position AS row_idx
FROM claim_app k JOIN patient_appointment a ON a.name = k.appointment JOIN insurance_claim c ON c.name = k.claim
LEFT JOIN item_rate r ON r.item_code = a.billing_item AND r.company = c.company
  AND r.insurance_subscription = a.insurance_subscription AND r.insurance_company = a.insurance_company
WHERE a.follow_up = 0 AND a.has_no_consultation_charges <> 1 AND k.claim NOT IN (SELECT claim FROM claim_record)"""

_LINE = """claim, item_name, item_code, CAST(item_quantity AS double) AS item_quantity, unit_price, amount_claimed,
approval_ref_no, status, patient_encounter, ref_doctype, ref_docname, CAST(date_created AS varchar) AS date_created, item_crt_by"""
QUERIES["c4_outpatient_lines"] = f"SELECT {_LINE} FROM out_line"
QUERIES["c5_inpatient_lines"] = f"SELECT {_LINE} FROM in_line"
QUERIES["c6_consultation_lines"] = f"SELECT {_LINE} FROM consult_line"
QUERIES["c8_price_violations"] = """
SELECT claim, 'item_rate' AS rule, concat_ws(' ', ref_doctype, ref_docname, item_code) AS detail
FROM (SELECT * FROM bed_line UNION ALL SELECT * FROM consult_line) WHERE unit_price IS NULL"""
QUERIES["c8_rated_lines"] = f"""
SELECT {_LINE} FROM (SELECT * FROM bed_line UNION ALL SELECT * FROM consult_line)"""
STEPS["numbered"] = f"""
SELECT CAST(row_number() OVER (PARTITION BY claim ORDER BY ref_doctype NULLS FIRST, item_code NULLS FIRST,
         date_created NULLS FIRST, encounter_creation NULLS FIRST, patient_encounter NULLS FIRST,
         table_order NULLS FIRST, row_idx NULLS FIRST, ref_docname NULLS FIRST) + n AS int) AS idx, {_LINE}
FROM (SELECT l.*, k.n FROM (SELECT * FROM out_line UNION ALL SELECT * FROM in_line) l
      JOIN (SELECT claim, count(*) AS n FROM claim_app GROUP BY claim) k USING (claim))
UNION ALL
SELECT CAST(row_number() OVER (PARTITION BY claim ORDER BY row_idx) AS int) AS idx, {_LINE} FROM consult_line"""
QUERIES["c9_claim_lines"] = "SELECT * FROM numbered"
QUERIES["c10_claim_totals"] = """
SELECT parent AS claim, CAST(sum(CAST(unit_price * item_quantity AS decimal(18,4))) AS double) AS total_amount
FROM claim_item GROUP BY parent"""
QUERIES["c10_completed_diseases"] = """
SELECT d.* REPLACE (CAST(coalesce(d.date_created, DATE '2002-03-04') AS varchar) AS date_created), h.folio_id,
    sha256(concat_ws('|', d.claim, d.status, d.codification_table)) AS folio_disease_id
FROM disease_rows d LEFT JOIN claim_header h ON h.name = d.claim"""
QUERIES["c10_completed_items"] = """
SELECT i.* REPLACE (i.unit_price * i.item_quantity AS amount_claimed,
    coalesce(nullif(i.folio_item_id, ''), sha256(concat_ws('|', i.parent, i.ref_doctype, i.ref_docname, i.idx))) AS folio_item_id,
    CAST(coalesce(i.date_created, DATE '2002-03-04') AS varchar) AS date_created,
    coalesce(nullif(i.folio_id, ''), h.folio_id) AS folio_id)
FROM claim_item i LEFT JOIN claim_header h ON h.name = i.parent"""
QUERIES["c13_item_reference_codes"] = """
SELECT i.item_code, min(d.ref_code) AS ref_code FROM item i
LEFT JOIN item_customer_detail d ON d.parent = i.item_code AND coalesce(d.customer_name, '') <> 'NHIF' GROUP BY i.item_code"""
QUERIES["c13_missing_reference_codes"] = """
SELECT i.item_code, 'item_reference_code' AS rule FROM item i
LEFT JOIN item_customer_detail d ON d.parent = i.item_code AND coalesce(d.customer_name, '') <> 'NHIF'
GROUP BY i.item_code HAVING coalesce(min(d.ref_code), '') = ''"""
