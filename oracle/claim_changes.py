"""Checking SQL of notes, export, reconciling, merging and change tracking."""

STEPS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

STEPS["note_enc"] = """
SELECT claim, encounter, 0 AS position, creation FROM out_enc
UNION ALL SELECT claim, encounter, position, creation FROM in_enc"""
STEPS["drug_text"] = """
SELECT parent AS encounter, '<br>Medication(s): <br>' || string_agg(
  'Drug: ' || coalesce(drug_code, 'None') || ' ' || CASE WHEN dosage <> '' THEN ', Dosage: ' || dosage ELSE '' END
  || CASE WHEN period <> '' THEN ', Period: ' || period ELSE '' END
  || CASE WHEN dosage_form <> '' THEN ', Dosage Form: ' || dosage_form ELSE '' END || '<br>', '' ORDER BY idx, name) AS drugs
FROM drug_prescription GROUP BY parent"""
STEPS["enc_text"] = """
SELECT e.name AS encounter, '<br>PractitionerName: <i>' || coalesce(e.practitioner_name, 'None') || ',</i> Speciality: <i>'
  || coalesce(p.department, 'None') || ',</i> DateofService: <i>' || coalesce(CAST(e.encounter_date AS varchar), 'None') || ' '
  || coalesce(e.encounter_time, 'None') || '</i> <br>' || coalesce(e.examination_detail, '') || coalesce(d.drugs, '') AS note
FROM patient_encounter e LEFT JOIN healthcare_practitioner p ON p.name = e.practitioner
LEFT JOIN drug_text d ON d.encounter = e.name"""
STEPS["notes"] = """
SELECT n.claim, replace('Patient: <b>' || coalesce(min(h.patient_name), 'None') || '</b>, Gender: <b>' || coalesce(min(h.gender), 'None')
  || '</b>, Date of Birth: <b>' || coalesce(CAST(min(h.date_of_birth) AS varchar), 'None') || '</b>, Age: <b>'
  || coalesce(CAST(date_diff('day', min(h.date_of_birth), DATE '2002-03-04') // 365 AS varchar), 'None') || ' years</b>,<br>'
  || string_agg(x.note, '' ORDER BY n.position, n.creation, n.encounter), '"', ' ') AS clinical_notes
FROM note_enc n JOIN enc_text x ON x.encounter = n.encounter JOIN claim_header h ON h.name = n.claim GROUP BY n.claim"""
QUERIES["c11_clinical_notes"] = "SELECT claim, clinical_notes FROM notes"
QUERIES["c11_missing_examination"] = """
SELECT n.claim, n.encounter FROM note_enc n JOIN patient_encounter e ON e.name = n.encounter
WHERE coalesce(e.examination_detail, '') = ''"""

STEPS["disease_text"] = """
SELECT claim, CAST(count(*) AS int) AS n, string_agg(concat_ws('|', coalesce(status, 'null'), coalesce(disease_code, 'null'), 'null',
    coalesce(item_crt_by, 'null'), coalesce(CAST(date_created AS varchar), 'None')), ',' ORDER BY status DESC, medical_code) AS txt
FROM disease_rows GROUP BY claim"""
STEPS["item_text"] = """
SELECT claim, CAST(count(*) AS int) AS n, string_agg(concat_ws('|', coalesce(item_code, 'null'),
    coalesce(CAST(CAST(trunc(item_quantity) AS int) AS varchar), 'null'), coalesce(CAST(CAST(unit_price AS decimal(18,4)) AS varchar), 'null'),
    coalesce(CAST(CAST(amount_claimed AS decimal(18,4)) AS varchar), 'null'), coalesce(nullif(approval_ref_no, ''), 'null'),
    coalesce(item_crt_by, 'null'), coalesce(date_created, 'None')), ',' ORDER BY idx, ref_docname) AS txt
FROM numbered GROUP BY claim"""
STEPS["saved_header"] = """
SELECT h.* REPLACE (CASE WHEN h.practitioner_no IS NULL AND h.name IN (SELECT claim FROM claim_people) THEN '' ELSE h.practitioner_no END
    AS practitioner_no), coalesce(i.total_amount, 0.0) AS total_amount, f.folio_no, n.clinical_notes
FROM claim_header h LEFT JOIN folio_no f ON f.claim = h.name LEFT JOIN notes n ON n.claim = h.name
LEFT JOIN (SELECT claim, CAST(sum(CAST(unit_price * item_quantity AS decimal(18,4))) AS double) AS total_amount
           FROM numbered GROUP BY claim) i ON i.claim = h.name"""
_TEXT_DATES = """CAST(date_of_birth AS varchar) AS date_of_birth, CAST(posting_date AS varchar) AS posting_date,
  CAST(date_discharge AS varchar) AS date_discharge, CAST(date_admitted AS varchar) AS date_admitted,
  CAST(attendance_date AS varchar) AS attendance_date, CAST(creation AS varchar) AS creation"""
QUERIES["c10_saved_headers"] = f"SELECT * REPLACE ({_TEXT_DATES}) FROM saved_header"
_HEAD_KEYS = (
    "ClaimYear,ClaimMonth,FolioNo,SerialNo,FacilityCode,CardNo,FirstName,LastName,Gender,DateOfBirth,PatientFileNo,ClaimFile,"
    "ClinicalNotes,AuthorizationNo,AttendanceDate,PatientTypeCode"
)
_TAIL_KEYS = "PractitionerName,PractitionerNo,CreatedBy,DateCreated,BillNo,LateSubmissionReason,FolioDiseases,FolioItems,PatientFile"
QUERIES["c12_folio_documents"] = f"""
SELECT h.name AS claim, '{_HEAD_KEYS},' || CASE WHEN h.patient_type_code = 'IN' THEN 'DateAdmitted,DateDischarged,' ELSE '' END || '{_TAIL_KEYS}' AS keys,
  h.name AS billno, CAST(h.folio_no AS varchar) AS foliono, CAST(h.serial_no AS varchar) AS serialno,
  CAST(h.claim_year AS varchar) AS claimyear, CAST(h.claim_month AS varchar) AS claimmonth, h.facility_code AS facilitycode,
  trim(h.cardno) AS cardno, h.first_name AS firstname, h.last_name AS lastname, h.gender,
  coalesce(CAST(h.date_of_birth AS varchar), 'None') AS dateofbirth, h.patient_file_no AS patientfileno, 'Stripped off' AS claimfile,
  h.clinical_notes AS clinicalnotes, h.authorization_no AS authorizationno,
  coalesce(CAST(h.attendance_date AS varchar), 'None') AS attendancedate, h.patient_type_code AS patienttypecode,
  CASE WHEN h.patient_type_code = 'IN' THEN coalesce(CAST(h.date_admitted AS varchar), 'None') || ' ' || coalesce(h.admitted_time, 'None') END AS dateadmitted,
  CASE WHEN h.patient_type_code = 'IN' THEN coalesce(CAST(h.date_discharge AS varchar), 'None') || ' ' || coalesce(h.discharge_time, 'None') END AS datedischarged,
  h.practitioner_name AS practitionername, h.practitioner_no AS practitionerno, h.item_crt_by AS createdby,
  coalesce(CAST(h.posting_date AS varchar), 'None') AS datecreated, h.delayreason AS latesubmissionreason, 'Stripped off' AS patientfile,
  coalesce(d.n, 0) AS diseases, coalesce(d.txt, '') AS disease_rows, coalesce(i.n, 0) AS items, coalesce(i.txt, '') AS item_rows
FROM saved_header h LEFT JOIN disease_text d ON d.claim = h.name LEFT JOIN item_text i ON i.claim = h.name"""


def _reconciled(table, recompute):
    amount = "min_by(unit_price, idx) * sum(item_quantity)" if recompute else (
        "CAST(sum(CAST(amount_claimed AS decimal(18,4))) AS double)")
    firsts = ", ".join(
        f"arg_min_null({c}, idx) AS {c}"
        for c in ("name", "item_name", "unit_price", "ref_doctype", "folio_item_id", "folio_id", "item_crt_by", "date_created")
    )
    return f"""
SELECT parent, item_code, CAST(min(idx) AS int) AS idx, {firsts},
       CAST(sum(item_quantity) AS int) AS item_quantity, {amount} AS amount_claimed,
       string_agg(nullif(approval_ref_no, ''), ',' ORDER BY idx) AS approval_ref_no,
       array_to_string(list_sort(list(DISTINCT patient_encounter)), ',') AS patient_encounter,
       array_to_string(list_sort(list(DISTINCT ref_docname)), ',') AS ref_docname,
       CASE WHEN bool_or(status = 'Submitted') THEN 'Submitted' ELSE arg_min_null(status, idx) END AS status
FROM {table} GROUP BY parent, item_code"""


STEPS["original_once"] = _reconciled("original_claim_item", False)
STEPS["item_once"] = _reconciled("claim_item", True)
_TEXT_DATE = "REPLACE (CAST(date_created AS varchar) AS date_created)"
QUERIES["m1_reconciled_items"] = f"SELECT * {_TEXT_DATE} FROM item_once"
QUERIES["m1_reconciled_originals"] = f"SELECT * {_TEXT_DATE} FROM original_once"

STEPS["merge_group"] = """
SELECT min(c.name) AS claim, c.patient, c.attendance_date, c.cardno, c.coverage_plan_name, CAST(count(DISTINCT c.name) AS int) AS claims,
       '["' || array_to_string(list_sort(list(DISTINCT k.appointment)), '","') || '"]' AS claim_appointment_list, 0 AS allow_changes
FROM insurance_claim c JOIN claim_app k ON k.claim = c.name WHERE coalesce(c.patient, '') <> ''
GROUP BY c.patient, c.attendance_date, c.cardno, c.coverage_plan_name"""
QUERIES["m2_merged_claims"] = """
SELECT * REPLACE (CAST(attendance_date AS varchar) AS attendance_date) FROM merge_group WHERE claims > 1"""
QUERIES["m2_single_claims"] = """
SELECT claim, 'merge' AS rule, patient AS detail FROM merge_group WHERE claims = 1
UNION ALL SELECT name, 'merge_without_patient', patient FROM insurance_claim WHERE coalesce(patient, '') = ''"""
QUERIES["m3_original_snapshot"] = f"SELECT * EXCLUDE (name) {_TEXT_DATE} FROM claim_item"
STEPS["original_names"] = """
SELECT DISTINCT parent, unnest(string_split(ref_docname, ',')) AS reference FROM original_claim_item"""
QUERIES["m4_missing_originals"] = f"""
SELECT i.* EXCLUDE (name) {_TEXT_DATE} FROM claim_item i
WHERE NOT EXISTS (SELECT 1 FROM original_names n WHERE n.parent = i.parent AND n.reference = i.ref_docname)"""
STEPS["once_tokens"] = "SELECT parent, item_code, unnest(string_split(ref_docname, ',')) AS reference FROM item_once"
QUERIES["m4_missing_originals_by_name"] = f"""
SELECT i.* EXCLUDE (name) {_TEXT_DATE} FROM item_once i
WHERE EXISTS (SELECT 1 FROM once_tokens k WHERE k.parent = i.parent AND k.item_code = i.item_code
  AND NOT EXISTS (SELECT 1 FROM original_names n WHERE n.parent = k.parent AND n.reference = k.reference))"""

STEPS["seen_ref"] = """
SELECT DISTINCT o.parent AS claim, coalesce(o.ref_docname, '') AS reference FROM original_once o
WHERE EXISTS (SELECT 1 FROM claim_item i WHERE i.parent = o.parent AND coalesce(i.item_code, '') = coalesce(o.item_code, ''))"""
STEPS["amount_event"] = """
SELECT i.parent AS claim, i.item_code, i.item_name, i.item_quantity AS quantity, 'Amount Changed' AS status,
       coalesce(o.amount_claimed, 0) AS previous_amount, coalesce(i.amount_claimed, 0) AS current_amount, i.ref_docname,
       i.ref_doctype, i.patient_encounter, CAST(NULL AS varchar) AS lrpmt_return, CAST(NULL AS varchar) AS medication_change_request
FROM claim_item i JOIN original_once o ON o.parent = i.parent AND coalesce(o.item_code, '') = coalesce(i.item_code, '')
WHERE coalesce(o.amount_claimed, 0) <> coalesce(i.amount_claimed, 0)"""
STEPS["gone_original"] = """
SELECT o.* FROM original_once o WHERE NOT EXISTS (
  SELECT 1 FROM seen_ref s WHERE s.claim = o.parent AND s.reference = coalesce(o.ref_docname, ''))"""
_EVENT = """parent AS claim, item_code, item_name, item_quantity AS quantity, {status} AS status, amount_claimed AS previous_amount,
  amount_claimed AS current_amount, {ref} AS ref_docname, ref_doctype, {enc} AS patient_encounter,
  {ret} AS lrpmt_return, {mcr} AS medication_change_request"""
_NULL = "CAST(NULL AS varchar)"
STEPS["appointment_event"] = f"""
SELECT {_EVENT.format(status="'Item Removed'", ref='ref_docname', enc='patient_encounter', ret=_NULL, mcr=_NULL)}
FROM gone_original WHERE ref_doctype = 'Patient Appointment'"""
STEPS["gone_name"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY parent, token ORDER BY idx, place) AS rn FROM (
    SELECT g.*, unnest(string_split(g.ref_docname, ',')) AS token, generate_subscripts(string_split(g.ref_docname, ','), 1) AS place
    FROM gone_original g WHERE g.ref_doctype <> 'Patient Appointment'))
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM seen_ref s WHERE s.claim = parent AND s.reference = token)"""
STEPS["change_request"] = """
SELECT d.drug_name, m.patient_encounter AS enc, min(m.name) AS request FROM medication_change_request m
JOIN medication_change_request_drug d ON d.parent = m.name
WHERE d.parenttype = 'Medication Change Request' AND d.parentfield = 'original_pharmacy_prescription' GROUP BY 1, 2"""
STEPS["drug_event"] = f"""
SELECT {_EVENT.format(status='verdict', ref='token', enc='coalesce(child_enc, patient_encounter)',
                      ret="CASE WHEN verdict = 'Item Cancelled' THEN return_doc END",
                      mcr="CASE WHEN verdict = 'Item Replaced' THEN request END")}
FROM (SELECT g.*, d.parent AS child_enc, r.return_doc, q.request,
        CASE WHEN d.name IS NULL AND q.request IS NOT NULL THEN 'Item Replaced'
             WHEN d.is_cancelled = 0 THEN 'Item Removed'
             WHEN d.is_cancelled = 1 AND r.return_doc IS NOT NULL THEN 'Item Cancelled' END AS verdict
      FROM gone_name g LEFT JOIN drug_prescription d ON d.name = g.token
      LEFT JOIN (SELECT child_name, encounter_no, min(parent) AS return_doc FROM medication_return GROUP BY 1, 2) r
        ON r.child_name = g.token AND r.encounter_no = d.parent
      LEFT JOIN change_request q ON q.drug_name = g.item_name AND q.enc = g.patient_encounter
      WHERE g.ref_doctype = 'Drug Prescription') WHERE verdict IS NOT NULL"""
_SERVICE_TYPES = "('Lab Prescription', 'Radiology Procedure Prescription', 'Procedure Prescription', 'Therapy Plan Detail')"
STEPS["service_event"] = f"""
SELECT {_EVENT.format(status='verdict', ref='token', enc='child_enc',
                      ret="CASE WHEN verdict = 'Item Cancelled' THEN return_doc END", mcr=_NULL)}
FROM (SELECT g.*, d.parent AS child_enc, r.return_doc,
        CASE WHEN d.is_cancelled = 0 THEN 'Item Removed'
             WHEN d.is_cancelled = 1 AND r.return_doc IS NOT NULL THEN 'Item Cancelled' END AS verdict
      FROM gone_name g JOIN rx d ON d.name = g.token AND d.ref_doctype = g.ref_doctype
      LEFT JOIN (SELECT child_name, encounter_no, min(parent) AS return_doc FROM item_return GROUP BY 1, 2) r
        ON r.child_name = g.token AND r.encounter_no = d.parent
      WHERE g.ref_doctype IN {_SERVICE_TYPES}) WHERE verdict IS NOT NULL"""
STEPS["stay_name"] = """
SELECT 'Inpatient Occupancy' AS dt, name, is_confirmed FROM inpatient_occupancy
UNION ALL SELECT 'Inpatient Consultancy', name, is_confirmed FROM inpatient_consultancy"""
STEPS["stay_event"] = f"""
SELECT {_EVENT.format(status="CASE WHEN is_confirmed = 0 THEN 'Item Unconfirmed' ELSE 'Item Removed' END",
                      ref="CASE WHEN is_confirmed = 0 THEN token ELSE ref_docname END", enc='patient_encounter', ret=_NULL, mcr=_NULL)}
FROM (SELECT g.*, s.is_confirmed FROM gone_name g LEFT JOIN stay_name s ON s.dt = g.ref_doctype AND s.name = g.token
      WHERE g.ref_doctype LIKE 'Inpatient%')"""
QUERIES["t1_amount_changes"] = "SELECT * FROM amount_event"
QUERIES["t2_removed_originals"] = """
SELECT parent AS claim, idx, item_code, ref_doctype, ref_docname, amount_claimed FROM gone_original"""
QUERIES["t2_removed_appointments"] = "SELECT * FROM appointment_event"
QUERIES["t3_drug_removals"] = "SELECT * FROM drug_event"
QUERIES["t4_service_removals"] = "SELECT * FROM service_event"
QUERIES["t4_unknown_prescriptions"] = f"""
SELECT parent AS claim, 'unknown_prescription' AS rule, token AS detail FROM gone_name g
WHERE ref_doctype IN {_SERVICE_TYPES} AND NOT EXISTS (SELECT 1 FROM rx d WHERE d.name = g.token AND d.ref_doctype = g.ref_doctype)"""
QUERIES["t5_stay_removals"] = "SELECT * FROM stay_event"
QUERIES["t6_change_requests"] = """
SELECT drug_name AS item_name, enc AS patient_encounter, request AS medication_change_request FROM change_request"""
QUERIES["t7_change_records"] = """
SELECT e.item_code, e.item_name, CAST(e.quantity AS int) AS quantity, h.claim_month, h.claim_year, h.company,
       '2002-03-04' AS posting_date, '05:06:07' AS posting_time, e.status, e.previous_amount, e.current_amount,
       abs(e.previous_amount - e.current_amount) AS amount_changed, e.claim AS insurance_claim, h.patient_appointment,
       e.ref_docname, e.ref_doctype, e.patient_encounter, e.lrpmt_return, e.medication_change_request,
       'batch@example.org' AS user_email, 'Batch' AS edited_by
FROM (SELECT * FROM amount_event UNION ALL SELECT * FROM appointment_event UNION ALL SELECT * FROM drug_event
      UNION ALL SELECT * FROM service_event UNION ALL SELECT * FROM stay_event) e LEFT JOIN claim_header h ON h.name = e.claim"""
