"""Checking SQL of the claim header."""

STEPS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

STEPS["claim_app"] = """
SELECT c.name AS claim, u.pos - 1 AS position, u.app AS appointment
FROM insurance_claim c, LATERAL (
  SELECT unnest(l) AS app, generate_subscripts(l, 1) AS pos FROM (SELECT
    CASE WHEN coalesce(c.claim_appointment_list, '') IN ('', '[]') THEN [c.patient_appointment]
         ELSE from_json(c.claim_appointment_list, '["VARCHAR"]') END AS l)) u"""
STEPS["claim_enc"] = """
SELECT DISTINCT a.claim, e.name AS encounter, e.encounter_date, e.creation, e.modified, e.practitioner
FROM claim_app a JOIN patient_encounter e ON a.appointment = e.appointment WHERE e.docstatus = 1"""
STEPS["claim_final"] = """
SELECT DISTINCT a.claim, e.name AS encounter, e.practitioner, e.inpatient_record, e.modified
FROM claim_app a JOIN patient_encounter e ON a.appointment = e.appointment
WHERE e.docstatus = 1 AND e.duplicated = 0 AND e.encounter_type = 'Final'"""
STEPS["claim_people"] = """
SELECT claim, min(practitioner) AS first_practitioner,
       string_agg(tz_mct_code, ',' ORDER BY practitioner) AS practitioner_no
FROM (SELECT DISTINCT f.claim, f.practitioner, p.tz_mct_code
      FROM claim_final f JOIN healthcare_practitioner p ON f.practitioner = p.name) GROUP BY claim"""
STEPS["claim_record"] = """
SELECT claim, inpatient_record FROM (
  SELECT claim, inpatient_record, row_number() OVER (PARTITION BY claim ORDER BY modified DESC, encounter DESC) AS rn
  FROM claim_final WHERE inpatient_record <> '') WHERE rn = 1"""
STEPS["stay_days"] = """
SELECT r.claim, r.inpatient_record, i.discharge_date,
       coalesce(i.scheduled_date, DATE '2002-03-04') < coalesce(CAST(i.admitted_datetime AS date), DATE '2002-03-04') AS early,
       i.scheduled_date, i.admitted_datetime, i.creation
FROM claim_record r LEFT JOIN inpatient_record i ON r.inpatient_record = i.name"""
STEPS["stay_admitted"] = """
SELECT claim, inpatient_record, discharge_date,
       CASE WHEN early THEN scheduled_date ELSE CAST(admitted_datetime AS date) END AS admitted_on,
       strftime(CASE WHEN early THEN creation ELSE admitted_datetime END, '%H:%M:%S') AS admitted_time
FROM stay_days"""
STEPS["stay"] = """
SELECT claim, inpatient_record, admitted_time,
       CASE WHEN same THEN 'OUT' ELSE 'IN' END AS patient_type_code,
       CASE WHEN NOT same THEN admitted_on END AS date_admitted,
       CASE WHEN NOT same THEN discharge_date END AS date_discharge,
       CASE WHEN NOT same THEN '05:06:07' END AS discharge_time
FROM (SELECT *, coalesce(admitted_on, DATE '2002-03-04') = coalesce(discharge_date, DATE '2002-03-04') AS same
      FROM stay_admitted)"""
STEPS["claim_header_base"] = """
SELECT c.name, c.patient_appointment, coalesce(c.patient, a.patient) AS patient, coalesce(c.company, a.company) AS company,
       coalesce(nullif(c.cardno, ''), a.coverage_plan_card_number) AS cardno, a.authorization_number AS authorization_no,
       coalesce(nullif(c.coverage_plan_name, ''), a.coverage_plan_name) AS coverage_plan_name,
       c.patient_signature, c.folio_id, c.delayreason, c.claim_appointment_list, c.docstatus, c.creation,
       a.appointment_date AS attendance_date, a.appointment_time AS attendance_time,
       s.inpatient_record, coalesce(s.patient_type_code, 'OUT') AS patient_type_code, s.date_admitted, s.admitted_time,
       s.date_discharge, s.discharge_time, p.practitioner_name, k.practitioner_no
FROM insurance_claim c LEFT JOIN patient_appointment a ON c.patient_appointment = a.name
LEFT JOIN stay s ON s.claim = c.name LEFT JOIN claim_people k ON k.claim = c.name
LEFT JOIN healthcare_practitioner p ON p.name = k.first_practitioner"""
STEPS["claim_header"] = """
SELECT b.name, b.patient_appointment, b.patient, p.patient_name, p.first_name, p.last_name, p.mobile AS telephone_no,
       p.dob AS date_of_birth, p.sex AS gender, b.company, DATE '2002-03-04' AS posting_date, b.inpatient_record, b.cardno,
       b.authorization_no, b.coverage_plan_name,
       coalesce(nullif(b.patient_signature, ''), nullif(p.patient_signature, '')) AS patient_signature,
       coalesce(nullif(b.folio_id, ''), sha256('folio|' || b.name)) AS folio_id, s.facility_code,
       CAST(year(coalesce(b.date_discharge, b.attendance_date)) AS int) AS claim_year,
       CAST(month(coalesce(b.date_discharge, b.attendance_date)) AS int) AS claim_month,
       CAST(right(b.name, 9) AS int) AS serial_no, 'Batch' AS item_crt_by, b.delayreason, b.practitioner_name,
       b.practitioner_no, b.date_discharge, b.discharge_time, b.date_admitted, b.admitted_time, b.patient_type_code,
       b.attendance_date, b.attendance_time, b.patient AS patient_file_no, b.claim_appointment_list, b.docstatus, b.creation
FROM claim_header_base b LEFT JOIN patient p ON b.patient = p.name
LEFT JOIN company_claim_settings s ON b.company = s.company"""
STEPS["folio_position"] = """
SELECT name AS claim, company, claim_year, claim_month,
       row_number() OVER (PARTITION BY company, claim_year, claim_month ORDER BY creation, name) AS position FROM claim_header"""
STEPS["folio_no"] = """
SELECT p.claim, p.company, p.claim_year, p.claim_month, CAST(coalesce(c.folio_no, 0) + p.position AS int) AS folio_no
FROM folio_position p LEFT JOIN folio_counter c
  ON p.company = c.company AND p.claim_year = c.claim_year AND p.claim_month = c.claim_month"""

QUERIES["h1_claim_appointments"] = "SELECT claim, CAST(position AS int) AS position, appointment FROM claim_app"
QUERIES["h2_claim_encounters"] = """
SELECT claim, encounter, CAST(encounter_date AS varchar) AS encounter_date, CAST(creation AS varchar) AS creation,
       CAST(row_number() OVER (PARTITION BY claim ORDER BY creation, encounter) AS int) AS sequence FROM claim_enc"""
QUERIES["h3_final_encounters"] = """
SELECT claim, encounter, practitioner, inpatient_record, CAST(modified AS varchar) AS modified,
       CAST(row_number() OVER (PARTITION BY claim ORDER BY modified DESC, encounter DESC) AS int) AS sequence FROM claim_final"""
QUERIES["h4_claim_practitioners"] = """
SELECT k.claim, k.first_practitioner, p.practitioner_name, p.tz_mct_code AS first_code,
       coalesce(k.practitioner_no, '') AS practitioner_no
FROM claim_people k JOIN healthcare_practitioner p ON p.name = k.first_practitioner"""
QUERIES["h5_claim_inpatient_record"] = "SELECT claim, inpatient_record FROM claim_record"
QUERIES["h6_claim_stays"] = """
SELECT c.name AS claim, s.inpatient_record, coalesce(s.patient_type_code, 'OUT') AS patient_type_code,
       CAST(s.date_admitted AS varchar) AS date_admitted, s.admitted_time,
       CAST(s.date_discharge AS varchar) AS date_discharge, s.discharge_time
FROM insurance_claim c LEFT JOIN stay s ON s.claim = c.name"""
QUERIES["h7_claim_period"] = "SELECT name AS claim, claim_year, claim_month FROM claim_header"
QUERIES["h8_claim_headers"] = """
SELECT * REPLACE (CAST(date_of_birth AS varchar) AS date_of_birth, CAST(posting_date AS varchar) AS posting_date,
  CAST(date_discharge AS varchar) AS date_discharge, CAST(date_admitted AS varchar) AS date_admitted,
  CAST(attendance_date AS varchar) AS attendance_date, CAST(creation AS varchar) AS creation,
  CASE WHEN practitioner_no IS NULL AND name IN (SELECT claim FROM claim_people) THEN '' ELSE practitioner_no END AS practitioner_no)
FROM claim_header"""
QUERIES["h9_folio_numbers"] = "SELECT * FROM folio_no"
QUERIES["h9_folio_counters"] = """
SELECT company, claim_year, claim_month, max(folio_no) AS folio_no
FROM (SELECT company, claim_year, claim_month, folio_no FROM folio_no
      UNION ALL SELECT company, claim_year, claim_month, folio_no FROM folio_counter)
GROUP BY company, claim_year, claim_month"""
QUERIES["h10_eligible_appointments"] = """
SELECT name, patient, insurance_company, insurance_subscription, nhif_patient_claim FROM patient_appointment
WHERE coalesce(nhif_patient_claim, '') IN ('', 'None') AND coalesce(insurance_company, '') NOT LIKE '%NHIF%'
  AND coalesce(insurance_subscription, '') NOT IN ('', 'None')"""
QUERIES["h11_link_appointments"] = """
SELECT a.name, CASE WHEN l.claim IS NOT NULL THEN l.claim
                    WHEN a.nhif_patient_claim IN (SELECT name FROM insurance_claim) THEN ''
                    ELSE a.nhif_patient_claim END AS nhif_patient_claim
FROM patient_appointment a LEFT JOIN (
  SELECT appointment, claim FROM (
    SELECT k.appointment, k.claim, row_number() OVER (PARTITION BY k.appointment ORDER BY c.creation DESC, k.claim DESC) AS rn
    FROM claim_app k JOIN insurance_claim c ON k.claim = c.name) WHERE rn = 1) l ON l.appointment = a.name"""
QUERIES["h11_unlink_deleted_claims"] = """
SELECT a.name, CASE WHEN EXISTS (SELECT 1 FROM insurance_claim c WHERE c.docstatus = 0 AND c.patient_appointment = a.name
                                 AND c.name = a.nhif_patient_claim) THEN '' ELSE a.nhif_patient_claim END AS nhif_patient_claim
FROM patient_appointment a"""
QUERIES["h12_claims_with_returns"] = """
SELECT c.name AS claim, string_agg(r.name, ',' ORDER BY r.name) AS return_documents
FROM insurance_claim c JOIN lrpmt_returns r ON r.patient = c.patient AND r.appointment = c.patient_appointment
WHERE r.docstatus = 1 GROUP BY c.name"""
