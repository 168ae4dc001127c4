"""Checking SQL of the claim validation report."""

STEPS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

STEPS["v1"] = """
SELECT name AS claim, 'no_submitted_encounter' AS rule, CAST(NULL AS varchar) AS detail FROM insurance_claim
WHERE name NOT IN (SELECT claim FROM claim_enc)"""
STEPS["v2"] = """
SELECT name AS claim, 'no_final_encounter' AS rule, CAST(NULL AS varchar) AS detail FROM insurance_claim
WHERE name NOT IN (SELECT claim FROM claim_final)"""
STEPS["v3"] = """
SELECT k.claim, 'practitioner_name' AS rule, k.first_practitioner AS detail
FROM claim_people k JOIN healthcare_practitioner p ON p.name = k.first_practitioner WHERE coalesce(p.practitioner_name, '') = ''
UNION ALL
SELECT k.claim, 'practitioner_code', k.first_practitioner
FROM claim_people k JOIN healthcare_practitioner p ON p.name = k.first_practitioner WHERE coalesce(p.tz_mct_code, '') = ''"""
STEPS["v4"] = """
SELECT name AS claim, 'no_disease' AS rule, CAST(NULL AS varchar) AS detail FROM insurance_claim WHERE name NOT IN (SELECT claim FROM disease_rows)
UNION ALL
SELECT name, 'no_item', NULL FROM insurance_claim WHERE name NOT IN (SELECT parent FROM claim_item)"""
STEPS["v5"] = """
SELECT c.name AS claim, 'total_amount' AS rule, CAST(NULL AS varchar) AS detail FROM insurance_claim c
LEFT JOIN (SELECT parent, sum(CAST(amount_claimed AS decimal(18,4))) AS s FROM claim_item GROUP BY parent) i ON i.parent = c.name
WHERE coalesce(CAST(c.total_amount AS decimal(18,4)), 0) <> coalesce(i.s, 0)"""
STEPS["v6"] = """
SELECT parent AS claim, 'draft_item' AS rule, idx || ' ' || ref_doctype || ' ' || item_name AS detail
FROM claim_item WHERE status = 'Draft'"""
STEPS["v7"] = """
SELECT c.name AS claim, 'authorization_no' AS rule, a.name AS detail FROM insurance_claim c JOIN patient_appointment a
  ON a.name = c.patient_appointment WHERE c.authorization_no IS DISTINCT FROM a.authorization_number
UNION ALL
SELECT c.name, 'cardno', a.name FROM insurance_claim c JOIN patient_appointment a
  ON a.name = c.patient_appointment WHERE c.cardno IS DISTINCT FROM a.coverage_plan_card_number"""
STEPS["v8"] = """
SELECT c.name AS claim, 'other_insurer' AS rule, a.insurance_company AS detail FROM insurance_claim c JOIN patient_appointment a
  ON a.name = c.patient_appointment WHERE a.insurance_company IN ('NHIF', 'NHIF Town', 'NHIF Upanga - RSPDC')"""
STEPS["v9"] = """
SELECT claim, 'duplicate_draft' AS rule, patient_appointment AS detail FROM (
  SELECT name AS claim, patient_appointment, count(*) OVER (PARTITION BY patient, patient_appointment, cardno) AS n
  FROM insurance_claim WHERE docstatus = 0) WHERE n > 1"""
STEPS["v10"] = """
SELECT h.name AS claim, CASE WHEN s.submit_claim_month IS NULL AND s.submit_claim_year IS NULL THEN 'no_submission_period'
                             ELSE 'submission_period' END AS rule, h.claim_year || '-' || h.claim_month AS detail
FROM claim_header h LEFT JOIN company_claim_settings s ON s.company = h.company
WHERE h.claim_month IS DISTINCT FROM s.submit_claim_month OR h.claim_year IS DISTINCT FROM s.submit_claim_year"""
STEPS["v11"] = """
SELECT name AS claim, 'patient_signature' AS rule, patient AS detail FROM claim_header WHERE patient_signature IS NULL"""
STEPS["held"] = """
SELECT name, patient, patient_appointment, cardno FROM insurance_claim WHERE docstatus = 0 AND workflow_state = 'Unclaimable'"""
STEPS["held_group"] = """
SELECT patient, patient_appointment, cardno, count(*) AS open_claims FROM held GROUP BY patient, patient_appointment, cardno"""
STEPS["held_app"] = """
SELECT DISTINCT h.patient, h.patient_appointment, h.cardno, k.appointment FROM held h JOIN claim_app k ON k.claim = h.name
JOIN insurance_claim c ON c.name = h.name WHERE coalesce(c.claim_appointment_list, '') NOT IN ('', '[]')"""
STEPS["visit_app"] = "SELECT * FROM patient_appointment WHERE status <> 'Cancelled'"
STEPS["claim_visit_app"] = """
SELECT c.name AS claim, v.name AS appointment FROM insurance_claim c JOIN visit_app v ON v.patient IS NOT DISTINCT FROM c.patient
  AND v.appointment_date IS NOT DISTINCT FROM c.attendance_date AND v.coverage_plan_card_number IS NOT DISTINCT FROM c.cardno
  AND v.coverage_plan_name IS NOT DISTINCT FROM c.coverage_plan_name"""
STEPS["claim_held_app"] = """
SELECT c.name AS claim, m.appointment FROM insurance_claim c JOIN held_app m
  ON m.patient IS NOT DISTINCT FROM c.patient AND m.patient_appointment IS NOT DISTINCT FROM c.patient_appointment
  AND m.cardno IS NOT DISTINCT FROM c.cardno"""
STEPS["visits"] = """
SELECT c.name AS claim, coalesce(h.open_claims, 0) AS open_claims, coalesce(v.n, 0) AS appointments,
       coalesce(m.n, 0) AS merged, coalesce(b.n, 0) AS merged_here
FROM insurance_claim c LEFT JOIN held_group h ON h.patient IS NOT DISTINCT FROM c.patient AND h.patient_appointment IS NOT DISTINCT FROM c.patient_appointment
  AND h.cardno IS NOT DISTINCT FROM c.cardno
LEFT JOIN (SELECT claim, count(*) AS n FROM claim_visit_app GROUP BY claim) v ON v.claim = c.name
LEFT JOIN (SELECT claim, count(*) AS n FROM claim_held_app GROUP BY claim) m ON m.claim = c.name
LEFT JOIN (SELECT a.claim, count(*) AS n FROM claim_visit_app a JOIN claim_held_app x ON x.claim = a.claim AND x.appointment = a.appointment
           GROUP BY a.claim) b ON b.claim = c.name"""
STEPS["v12"] = """
SELECT claim, 'merge_claims' AS rule, CAST(open_claims AS varchar) AS detail FROM visits WHERE open_claims > 1
UNION ALL
SELECT claim, 'merge_appointments', CAST(appointments AS varchar) FROM visits WHERE appointments > 1 AND merged_here < appointments"""

for _number, _name in enumerate(
    ("without_encounters", "without_final_encounters", "practitioners", "without_rows", "total_amount", "draft_items",
     "appointment_mismatches", "other_insurers", "duplicate_drafts", "submission_period", "missing_signatures", "merge_needed"), 1
):
    QUERIES[f"v{_number}_{_name}"] = f"SELECT claim, rule, detail FROM v{_number}"
QUERIES["v3_left_out_codes"] = """
SELECT DISTINCT f.claim, 'practitioner_code' AS rule, f.practitioner AS detail
FROM claim_final f JOIN healthcare_practitioner p ON p.name = f.practitioner WHERE coalesce(p.tz_mct_code, '') = ''"""
QUERIES["v13_card_decisions"] = """
SELECT claim, CASE WHEN appointments <= 1 OR appointments - 1 = greatest(merged, open_claims) THEN 'Release' ELSE 'Hold' END AS decision
FROM visits"""
QUERIES["v_claim_violations"] = " UNION ALL ".join(f"SELECT claim, rule, detail FROM v{n}" for n in range(1, 13))
