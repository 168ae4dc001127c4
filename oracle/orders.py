"""Checking SQL of orders, stock and deliveries."""

STEPS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

STEPS["order_enc"] = """
SELECT * FROM patient_encounter WHERE docstatus = 1
  AND (coalesce(inpatient_record, '') = '' OR coalesce(insurance_subscription, '') <> '')"""
QUERIES["s1_order_encounters"] = "SELECT name, inpatient_record, insurance_subscription FROM order_enc"
_DOSAGE = """'frequency: ' || coalesce(nullif(x.dosage, ''), 'No Prescription Dosage')
  || ', <br>period: ' || coalesce(nullif(x.period, ''), 'No Prescription Period')
  || ', <br>dosage_form: ' || coalesce(x.dosage_form, '') || ', <br>interval: ' || coalesce(x.interval, '')
  || ', <br>interval_uom: ' || coalesce(x.interval_uom, '')
  || ', <br>medical_code: ' || coalesce(nullif(x.medical_code, ''), 'No medical code')
  || ', <br>Doctor''s comment: ' || coalesce(nullif(x.comment, ''), 'Take medication as per dosage.')"""
STEPS["order_line"] = f"""
SELECT x.parent AS encounter, CASE x.ref_doctype WHEN 'Drug Prescription' THEN 'drug' WHEN 'Lab Prescription' THEN 'lab' ELSE 'other' END AS category,
       p.item AS item_code, i.item_name, i.description,
       CASE WHEN x.ref_doctype = 'Drug Prescription' THEN x.quantity - x.quantity_returned ELSE 1.0 END AS qty,
       '2002-03-04' AS delivery_date, w.warehouse, x.ref_doctype AS reference_dt, x.name AS reference_dn,
       CASE WHEN x.ref_doctype = 'Drug Prescription' THEN {_DOSAGE} END AS dosage_info
FROM rx x JOIN order_enc e ON e.name = x.parent LEFT JOIN item_template p ON p.template_type = x.template_type AND p.name = x.template
LEFT JOIN item i ON i.item_code = p.item LEFT JOIN company_warehouse w ON w.company = e.company
WHERE x.prescribe <> 0 AND x.is_not_available_inhouse <> 1 AND x.is_cancelled <> 1"""
QUERIES["s2_order_lines"] = "SELECT * EXCLUDE (dosage_info) FROM order_line"
QUERIES["s3_dosage_text"] = "SELECT reference_dn, dosage_info FROM order_line WHERE category = 'drug'"
STEPS["priced_enc"] = """
SELECT e.*, w.warehouse, coalesce(nullif(m.price_list, ''), nullif(c.default_price_list, '')) AS price_list
FROM order_enc e LEFT JOIN company_warehouse w ON w.company = e.company
LEFT JOIN mode_of_payment m ON m.name = e.mode_of_payment LEFT JOIN company c ON c.name = e.company"""
QUERIES["s4_order_headers"] = """
SELECT sha256(l.encounter || '|' || l.category) AS name, l.encounter, l.category, e.company, p.customer, e.patient, e.patient_name,
       p.mobile AS patient_mobile_number, '2002-03-04' AS transaction_date, '2002-03-04' AS delivery_date, e.price_list,
       e.warehouse AS set_warehouse, e.healthcare_service_unit, e.practitioner AS healthcare_practitioner
FROM (SELECT DISTINCT encounter, category FROM order_line) l JOIN priced_enc e ON e.name = l.encounter
LEFT JOIN patient p ON p.name = e.patient WHERE e.warehouse IS NOT NULL AND e.price_list IS NOT NULL"""
QUERIES["s4_order_violations"] = """
SELECT name AS encounter, 'unknown_warehouse' AS rule, company AS detail FROM priced_enc WHERE warehouse IS NULL
UNION ALL SELECT name, 'no_price_list', mode_of_payment FROM priced_enc
WHERE warehouse IS NOT NULL AND price_list IS NULL AND name IN (SELECT encounter FROM order_line)"""
QUERIES["s5_dosage_template"] = """
SELECT o.* REPLACE (CASE WHEN i.is_stock_item = 1 THEN 'Drug Prescription' ELSE o.reference_dt END AS reference_dt,
  CASE WHEN i.is_stock_item = 1 AND coalesce(o.dosage_info, '') = ''
       THEN 'frequency: , ' || chr(10) || 'period: , ' || chr(10) || 'dosage_form: , ' || chr(10) || 'interval: , ' || chr(10)
            || 'interval_uom: , ' || chr(10) || 'Doctor''s comment: '
       ELSE o.dosage_info END AS dosage_info)
FROM sales_order_item o LEFT JOIN item i ON i.item_code = o.item_code"""
STEPS["on_hand"] = """
SELECT item_code, warehouse, coalesce(qty_after_transaction, 0.0) AS actual_qty FROM (
  SELECT *, row_number() OVER (PARTITION BY item_code, warehouse ORDER BY creation DESC, name DESC) AS rn
  FROM stock_ledger_entry WHERE is_cancelled = 0) WHERE rn = 1"""
QUERIES["s6_stock_on_hand"] = "SELECT * FROM on_hand"


def _stock(items, severity, not_stock):
    other = "WHEN coalesce(i.is_stock_item, 0) <> 1 AND x.reference_dt = 'Drug Prescription' THEN 'not_a_stock_item'" if not_stock else ""
    return f"""
SELECT * FROM (SELECT x.parent, x.idx, x.item_code, x.warehouse,
  CASE WHEN i.is_stock_item = 1 AND x.qty > coalesce(s.actual_qty, 0) THEN 'shortage' {other} END AS rule, '{severity}' AS severity,
  x.qty, CASE WHEN i.is_stock_item = 1 THEN coalesce(s.actual_qty, 0.0) END AS available
FROM ({items}) x LEFT JOIN item i ON i.item_code = x.item_code
LEFT JOIN on_hand s ON s.item_code = x.item_code AND s.warehouse = x.warehouse) WHERE rule IS NOT NULL"""


_ORDER = """SELECT x.parent, x.idx, x.item_code, x.qty, x.reference_dt, o.set_warehouse AS warehouse
FROM sales_order_item x JOIN sales_order o ON o.name = x.parent"""
_INVOICE = """SELECT x.parent, x.idx, x.item_code, x.qty, x.reference_dt, x.warehouse
FROM sales_invoice_item x JOIN sales_invoice v ON v.name = x.parent WHERE v.enabled_auto_create_delivery_notes IS DISTINCT FROM 0"""
STEPS["first_item"] = "SELECT * FROM sales_invoice_item WHERE idx = 1"
QUERIES["s7_order_stock_validate"] = _stock(_ORDER, "warn", True)
QUERIES["s7_order_stock_submit"] = _stock(_ORDER, "error", False)
QUERIES["s8_invoice_stock_validate"] = _stock(
    _INVOICE + """ AND x.parent IN (SELECT parent FROM first_item WHERE sales_order <> '' AND reference_dt = 'Drug Prescription')""",
    "warn", True,
)
QUERIES["s8_invoice_stock_submit"] = _stock(_INVOICE, "error", False)
QUERIES["s9_order_dimensions"] = """
SELECT x.* REPLACE (
  CASE WHEN o.name IS NOT NULL AND coalesce(x.healthcare_practitioner, '') = '' THEN o.healthcare_practitioner ELSE x.healthcare_practitioner END AS healthcare_practitioner,
  CASE WHEN o.name IS NOT NULL AND coalesce(x.healthcare_service_unit, '') = '' THEN o.healthcare_service_unit ELSE x.healthcare_service_unit END AS healthcare_service_unit,
  CASE WHEN o.name IS NOT NULL AND coalesce(x.department, '') = '' THEN o.department ELSE x.department END AS department)
FROM sales_invoice_item x LEFT JOIN first_item f ON f.parent = x.parent AND f.sales_order <> ''
LEFT JOIN sales_order o ON o.name = f.sales_order"""
STEPS["delivered"] = """
SELECT d.* REPLACE (CASE WHEN coalesce(d.description, '') NOT LIKE '%frequency%' AND d.si_detail <> '' THEN i.dosage_info
                         ELSE d.description END AS description)
FROM delivery_note_item d LEFT JOIN sales_invoice_item i ON i.name = d.si_detail"""
QUERIES["s10_invoice_dosage"] = "SELECT name, parent, item_code, description FROM delivered"
_FIELDS = [
    ("dosage", "frequency", "default_prescription_dosage"), ("period", "period", "default_prescription_duration"),
    ("dosage_form", "dosage_form", "default_dosage_form"), ("interval", "interval", "default_interval"),
    ("interval_uom", "interval_uom", "default_interval_uom"), ("comment", "Doctor''s comment", "default_comments"),
]
STEPS["dosed"] = f"""
SELECT d.*, m.name AS drug_code, m.medication_name,
  {', '.join(f"coalesce(nullif(regexp_extract(d.description, '{key}:[[:space:]]*(.+)', 1), ''), m.{default}) AS {field}" for field, key, default in _FIELDS)}
FROM delivered d LEFT JOIN medication m ON m.item = d.item_code"""
QUERIES["s11_dosage_fields"] = "SELECT name, drug_code, dosage, period, dosage_form, interval, interval_uom, comment FROM dosed"
STEPS["note"] = """
SELECT * FROM delivery_note WHERE form_sales_invoice <> '' AND patient <> '' AND reference_name <> ''"""
STEPS["diagnosis"] = """
SELECT parent, medical_code || chr(10) || description AS medical_code FROM (
  SELECT *, row_number() OVER (PARTITION BY parent ORDER BY idx, name) AS rn FROM codification_table
  WHERE parenttype = 'Patient Encounter' AND parentfield = 'patient_encounter_final_diagnosis') WHERE rn = 1"""
STEPS["refused"] = """
SELECT n.name AS note, 'no_medication' AS rule, d.item_code AS detail FROM dosed d JOIN note n ON n.name = d.parent WHERE d.drug_code IS NULL
UNION ALL SELECT n.name, 'no_final_diagnosis', n.reference_name FROM note n WHERE n.reference_name NOT IN (SELECT parent FROM diagnosis)"""
QUERIES["s12_dispensing_violations"] = "SELECT * FROM refused"
STEPS["accepted"] = """
SELECT d.*, n.reference_name AS encounter, n.company, n.set_warehouse, n.form_sales_invoice FROM dosed d JOIN note n ON n.name = d.parent
WHERE n.name NOT IN (SELECT note FROM refused)"""
STEPS["pharmacy"] = """
SELECT company, warehouse, min(name) AS name FROM healthcare_service_unit WHERE service_unit_type = 'Pharmacy' GROUP BY company, warehouse"""
STEPS["dispensed"] = """
SELECT sha256(a.encounter || '|' || a.name) AS name, a.encounter AS parent, a.drug_code, a.medication_name AS drug_name, g.medical_code,
       1 AS prescribe, a.dosage, a.period, a.dosage_form, a.interval, a.interval_uom, a.comment, a.qty AS quantity, a.rate AS amount,
       a.name AS dn_detail, 1 AS drug_prescription_created, a.qty AS delivery_quantity, 1 AS invoiced,
       a.form_sales_invoice AS sales_invoice_number, p.name AS healthcare_service_unit
FROM accepted a JOIN diagnosis g ON g.parent = a.encounter
LEFT JOIN pharmacy p ON p.company = a.company AND p.warehouse = a.set_warehouse WHERE coalesce(a.reference_name, '') = ''"""
QUERIES["s12_dispensed_prescriptions"] = "SELECT * FROM dispensed"
STEPS["kept_drug"] = """
SELECT d.* FROM (SELECT * FROM drug_prescription UNION ALL BY NAME SELECT * FROM dispensed) d WHERE NOT (d.prescribe = 1 AND EXISTS (
  SELECT 1 FROM accepted a WHERE a.encounter = d.parent AND NOT EXISTS (
    SELECT 1 FROM accepted b WHERE b.parent = a.parent AND b.drug_code = d.drug_code)))"""
QUERIES["s13_updated_prescriptions"] = """
SELECT * REPLACE (CAST(modified AS varchar) AS modified) FROM kept_drug"""
