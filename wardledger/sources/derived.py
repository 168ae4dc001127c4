"""Hospital tables derived from the generic star-schema test tables.

Each entry is one SELECT in the part of SQL that Spark and DuckDB share, so the same text gives the
DataFrame here and the common table expression of the checking query. Braces name the test tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardledger.sources.tables import Tables, conform

# The test tables' columns that are used, declared so that opening them starts no job.
TEST_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}

# (l_orderkey, l_linenumber) is not unique, so rows are named by their whole content.
_ROW = (
    "l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'"
    "||CAST(round(l_extendedprice*100) AS bigint)"
)
_CLAIM = "'ICN-'||lpad(CAST({key} AS string), 9, '0')"
_ITEM = "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE 'ITEM-'||l_partkey END"
_SUBSCRIPTION = (
    "CASE c_mktsegment WHEN 'MACHINERY' THEN '' WHEN 'FURNITURE' THEN NULL ELSE 'SUB-'||c_custkey END"
)
_INSURER = "CASE WHEN c_mktsegment = 'BUILDING' THEN 'NHIF' ELSE 'INS-'||c_mktsegment END"
_REF_STATUS = "CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'O' THEN 0 ELSE 2 END"


def _claim(key: str) -> str:
    return _CLAIM.format(key=key)


def _prescription(kind: int, columns: str) -> str:
    return f"""
SELECT 'RX-'||{_ROW} AS name, 'ENC-'||l_orderkey AS parent, l_linenumber AS idx,
       {columns}
       CASE WHEN l_tax >= 0.065 THEN 1 ELSE 0 END AS is_cancelled,
       CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS prescribe,
       CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS is_not_available_inhouse,
       l_extendedprice AS amount, l_shipdate + INTERVAL '7' HOUR AS modified
FROM {{lineitem}} WHERE l_partkey % 5 = {kind}"""


def _service(kind: int, code: str, label: str, document: str) -> str:
    return _prescription(
        kind,
        f"""'TPL-'||l_partkey AS {code}, 'Service '||l_partkey AS {label},
       'HSU-'||(l_suppkey % 7) AS department_hsu,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'DOC-'||{_ROW} END AS {document},""",
    )


def _document(kind: int) -> str:
    return f"""
SELECT 'DOC-'||{_ROW} AS name, {_REF_STATUS} AS docstatus
FROM {{lineitem}} WHERE l_partkey % 5 = {kind} AND l_returnflag <> 'N' AND l_linenumber <> 5"""


def _claim_row(price: str, where: str) -> str:
    return _claim_columns(price, _claim("l_orderkey"), """row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""") + f"FROM {{lineitem}} WHERE l_orderkey % 2 = 0{where}"


def _dealt_claim_row(price: str, where: str) -> str:
    """The same rows for Spark, which numbers narrow rows that lie by claim, and names them after that.

    The number within an order is counted within the claim's name, which two orders may share.
    """
    numbered = f"""(SELECT *, row_number() OVER (PARTITION BY l_claim
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
            - rank() OVER (PARTITION BY l_claim ORDER BY l_orderkey) + 1 AS l_row_no
       FROM (SELECT *, {_claim('l_orderkey')} AS l_claim FROM {{lineitem}} WHERE l_orderkey % 2 = 0{where}))"""
    return _claim_columns(price, "l_claim", "l_row_no") + f"FROM {numbered}"


def _claim_columns(price: str, claim: str, row_no: str) -> str:
    return f"""
SELECT 'CI-'||{_ROW} AS name, {claim} AS parent,
       CAST({row_no} AS int) AS idx,
       'ITEM-'||(l_partkey % 6) AS item_code, 'Service '||(l_partkey % 6) AS item_name,
       CAST(l_quantity AS int) AS item_quantity, {price} AS unit_price,
       ({price}) * l_quantity AS amount_claimed,
       CASE WHEN l_linenumber = 1 THEN 'Patient Appointment'
            WHEN l_linenumber = 2 THEN 'Inpatient Occupancy'
            WHEN l_linenumber = 4 AND l_suppkey % 2 = 0 THEN 'Inpatient Consultancy'
            WHEN l_partkey % 5 = 0 THEN 'Lab Prescription'
            WHEN l_partkey % 5 = 1 THEN 'Radiology Procedure Prescription'
            WHEN l_partkey % 5 = 2 THEN 'Procedure Prescription'
            WHEN l_partkey % 5 = 3 THEN 'Drug Prescription'
            ELSE 'Therapy Plan Detail' END AS ref_doctype,
       CASE WHEN l_linenumber = 1 THEN 'APP-'||l_orderkey
            WHEN l_linenumber = 2 THEN 'OCC-'||{_ROW}
            WHEN l_linenumber = 4 AND l_suppkey % 2 = 0 THEN 'CONS-'||{_ROW}
            WHEN l_suppkey % 5 = 0 THEN 'GONE-'||{_ROW}
            ELSE 'RX-'||{_ROW} END AS ref_docname,
       'ENC-'||l_orderkey AS patient_encounter,
       CASE WHEN l_linestatus = 'F' THEN 'Submitted' ELSE 'Draft' END AS status,
       CASE WHEN l_tax >= 0.045 THEN 'APR-'||l_suppkey ELSE NULL END AS approval_ref_no,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_shipdate AS date) END AS date_created,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE 'FI-'||{_ROW} END AS folio_item_id,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE 'FOLIO-'||l_orderkey END AS folio_id,
       'HP-'||(l_suppkey % 110) AS item_crt_by
"""


def _invoice_columns(invoice: str, row_no: str) -> str:
    return f"""
SELECT 'SII-'||{_ROW} AS name, {invoice} AS parent,
       CAST({row_no} AS int) AS idx,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS docstatus,
       'ITEM-'||l_partkey AS item_code, p_type AS item_group, l_quantity AS qty, l_extendedprice AS amount,
       'WH-'||(l_suppkey % 3) AS warehouse, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'HP-'||l_suppkey END AS healthcare_practitioner,
       CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE 'HSU-'||(l_suppkey % 7) END AS healthcare_service_unit,
       CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE 'DEP-'||(l_suppkey % 4) END AS department,
       CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 AND l_partkey % 9 = 0 THEN '' ELSE 'SO-'||l_orderkey END AS sales_order,
       CASE WHEN l_partkey % 2 = 0 THEN 'Drug Prescription' ELSE NULL END AS reference_dt,
       CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'frequency: '||(l_suppkey % 5)||' x 1, <br>period: '||l_linenumber||' days, <br>dosage_form: Drops' END AS dosage_info
"""


_CLAIMED_PRICE = "CASE WHEN l_returnflag = 'A' THEN l_extendedprice + 10 ELSE l_extendedprice END"

_CLAIM_ROWS = {
    # Some claims gained items after their originals were kept.
    "original_claim_item": ("l_extendedprice", " AND NOT (l_orderkey % 5 = 0 AND l_linenumber % 3 = 0)"),
    "claim_item": (_CLAIMED_PRICE, " AND l_returnflag <> 'R'"),
}

DERIVED: dict[str, str] = {
    "healthcare_practitioner": """
SELECT 'HP-'||s_suppkey AS name,
       CASE WHEN s_suppkey % 29 = 0 THEN NULL ELSE s_name END AS practitioner_name,
       CASE WHEN s_nationkey % 2 = 0 THEN 'Consultant' ELSE 'Resident' END AS healthcare_practitioner_type,
       'MD-'||s_nationkey AS department,
       CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE 'MCT'||s_suppkey END AS tz_mct_code
FROM {supplier}""",
    "medical_department": """
SELECT 'MD-'||n_nationkey AS name, r_name AS main_department
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_regionkey <> 4""",
    "patient": """
SELECT 'PT-'||c_custkey AS name, 'CUST-'||c_custkey AS customer, '07'||c_custkey AS mobile,
       c_name AS patient_name, 'First '||c_custkey AS first_name, 'Last "'||c_custkey||'"' AS last_name,
       CAST('1950-01-01' AS date) + CAST(c_custkey % 20000 AS int) AS dob,
       CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' ELSE 'SIG-'||c_custkey END
           AS patient_signature
FROM {customer}""",
    "patient_appointment": f"""
SELECT 'APP-'||o_orderkey AS name, 'PT-'||o_custkey AS patient, 'HP-'||(o_orderkey % 110) AS practitioner,
       CASE WHEN o_custkey % 4 = 0 THEN CAST(date_trunc('month', o_orderdate) AS date)
            ELSE CAST(o_orderdate AS date) END AS appointment_date,
       '0'||(o_orderkey % 10)||':15:00' AS appointment_time, 'CO-'||(o_custkey % 3) AS company,
       CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Cancelled' END AS status,
       {_SUBSCRIPTION} AS insurance_subscription, {_INSURER} AS insurance_company,
       'PLAN-'||c_mktsegment AS coverage_plan_name, 'CARD-'||o_custkey AS coverage_plan_card_number,
       'AUTH-'||o_orderkey AS authorization_number,
       CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS follow_up, o_totalprice AS paid_amount,
       'HSU-'||(o_orderkey % 7) AS service_unit, 'ITEM-'||(o_orderkey % 200) AS billing_item,
       CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS has_no_consultation_charges,
       CASE WHEN o_orderkey % 4 = 0 THEN {_claim('o_orderkey')}
            WHEN o_orderkey % 12 = 2 THEN {_claim('o_orderkey - 2')}
            WHEN o_orderkey % 12 = 3 THEN 'None'
            WHEN o_orderkey % 4 = 1 THEN '' ELSE NULL END AS nhif_patient_claim,
       o_orderdate + INTERVAL '6' HOUR AS creation, o_orderdate + INTERVAL '30' HOUR AS modified
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "patient_encounter": f"""
SELECT 'ENC-'||o_orderkey AS name, 'APP-'||(o_orderkey - o_orderkey % 2) AS appointment,
       'HP-'||(o_orderkey % 110) AS practitioner, 'Dr '||(o_orderkey % 110) AS practitioner_name,
       CAST(o_orderdate AS date) AS encounter_date, '1'||(o_orderkey % 10)||':30:00' AS encounter_time,
       'CO-'||(o_custkey % 3) AS company, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS docstatus,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Ongoing' ELSE 'Final' END AS encounter_type,
       CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS duplicated,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'IPR-'||o_orderkey
            WHEN o_orderpriority = '2-HIGH' THEN '' ELSE NULL END AS inpatient_record,
       {_SUBSCRIPTION} AS insurance_subscription, {_INSURER} AS insurance_company,
       c_mktsegment AS insurance_coverage_plan, 'HSU-'||(o_orderkey % 7) AS healthcare_service_unit,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Exam "'||o_orderkey||'"' END AS examination_detail,
       'PT-'||o_custkey AS patient, c_name AS patient_name, 'MOP-'||(o_orderkey % 4) AS mode_of_payment,
       o_orderdate + INTERVAL '8' HOUR AS creation, o_orderdate + INTERVAL '9' HOUR AS modified
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "lab_prescription": _service(0, "lab_test_code", "lab_test_name", "lab_test"),
    "radiology_prescription": _service(
        1, "radiology_examination_template", "radiology_procedure_name", "radiology_examination"
    ),
    "procedure_prescription": _service(2, "procedure", "procedure_name", "clinical_procedure"),
    "drug_prescription": _prescription(
        3,
        """'TPL-'||l_partkey AS drug_code, 'Drug '||l_partkey AS drug_name,
       'HSU-'||(l_suppkey % 7) AS healthcare_service_unit,
       CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' AND l_suppkey % 4 = 0 THEN ''
            ELSE 'DNI-'||l_orderkey||'-'||l_partkey END AS dn_detail,
       l_quantity AS quantity,
       CASE WHEN l_discount >= 0.095 THEN l_quantity WHEN l_discount >= 0.075 THEN 1
            WHEN l_discount >= 0.065 THEN NULL ELSE 0 END AS quantity_returned,
       CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE '1 x '||(l_suppkey % 4) END AS dosage,
       CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE (l_suppkey % 9)||' days' END AS period,
       CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'Tablet' END AS dosage_form,
       CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE 'I'||(l_suppkey % 6) END AS interval,
       CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'Hour' END AS interval_uom,
       CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE 'ICD-'||(l_partkey % 8) END AS medical_code,
       CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'Take '||l_linenumber END AS comment,""",
    ),
    "therapy_plan_detail": _prescription(
        4, "'TPL-'||l_partkey AS therapy_type, 'HSU-'||(l_suppkey % 7) AS department_hsu,"
    ),
    "lab_test": f"""
SELECT CASE WHEN l_returnflag = 'N' THEN 'LT-' ELSE 'DOC-' END||{_ROW} AS name, {_REF_STATUS} AS docstatus,
       'ENC-'||l_orderkey AS ref_docname, 'Patient Encounter' AS ref_doctype, 'RX-'||{_ROW} AS ref_childname,
       CASE l_suppkey % 3 WHEN 0 THEN 'Lab Test Requested' WHEN 1 THEN 'Completed' ELSE NULL END AS workflow_state
FROM {{lineitem}} WHERE l_partkey % 5 = 0 AND l_linenumber <> 5""",
    "radiology_examination": _document(1),
    "clinical_procedure": _document(2),
    "approval": f"""
SELECT CASE l_partkey % 5 WHEN 0 THEN 'Lab Test' WHEN 1 THEN 'Radiology Examination'
            ELSE 'Clinical Procedure' END AS ref_doctype,
       'DOC-'||{_ROW} AS ref_docname, 'APR-'||l_suppkey AS approval_number
FROM {{lineitem}} WHERE l_partkey % 5 < 3 AND l_returnflag <> 'N' AND l_tax >= 0.045""",
    "item_template": """
SELECT CASE p_partkey % 5 WHEN 0 THEN 'Lab Test Template' WHEN 1 THEN 'Radiology Examination Template'
            WHEN 2 THEN 'Clinical Procedure Template' WHEN 3 THEN 'Medication' ELSE 'Therapy Type' END AS template_type,
       'TPL-'||p_partkey AS name,
       CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE 'ITEM-'||p_partkey END AS item
FROM {part}""",
    "medication": """
SELECT 'TPL-'||p_partkey AS name, 'ITEM-'||p_partkey AS item, p_name AS medication_name,
       'DI-'||(p_partkey % 3) AS default_interval, 'Day' AS default_interval_uom,
       (p_partkey % 7)||' days' AS default_prescription_duration, 'Syrup' AS default_dosage_form,
       '2 x 1' AS default_prescription_dosage, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'Default comment' END AS default_comments
FROM {part} WHERE p_partkey % 5 = 3""",
    "inpatient_record": f"""
SELECT 'IPR-'||o_orderkey AS name, 'APP-'||o_orderkey AS patient_appointment, 'CO-'||(o_custkey % 3) AS company,
       {_SUBSCRIPTION} AS insurance_subscription,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL
            ELSE CAST(o_orderdate AS date) + (CAST(o_orderkey % 3 AS int) - 1) END AS scheduled_date,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderdate + INTERVAL '14' HOUR END AS admitted_datetime,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderdate AS date) + CAST(o_orderkey % 4 AS int) END AS discharge_date,
       o_orderdate + INTERVAL '10' HOUR AS creation, 'ENC-'||o_orderkey AS admission_encounter
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""",
    "inpatient_occupancy": f"""
SELECT 'OCC-'||{_ROW} AS name, 'IPR-'||l_orderkey AS parent, l_linenumber AS idx,
       o_orderdate + INTERVAL '15' HOUR + INTERVAL '1' DAY * (l_linenumber - 1) AS check_in,
       'HSU-'||(l_suppkey % 7) AS service_unit, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_confirmed,
       l_extendedprice AS amount, l_shipdate + INTERVAL '7' HOUR AS modified, 'user'||(l_suppkey % 5) AS modified_by
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_linenumber <= 3""",
    "inpatient_consultancy": f"""
SELECT 'CONS-'||{_ROW} AS name, 'IPR-'||l_orderkey AS parent, l_linenumber AS idx,
       CAST(o_orderdate AS date) + CAST(l_linenumber - 4 AS int) AS date,
       'NAME-'||(l_partkey - l_partkey % 2) AS consultation_item,
       CASE WHEN l_suppkey % 16 = 0 THEN 0.0 ELSE l_extendedprice END AS rate,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'ENC-'||l_orderkey END AS encounter,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_confirmed,
       'HP-'||(l_suppkey % 110) AS healthcare_practitioner, l_shipdate + INTERVAL '7' HOUR AS modified
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_linenumber >= 4""",
    "healthcare_service_unit": """
SELECT DISTINCT 'HSU-'||(s_suppkey % 7) AS name, 'HSUT-'||(s_suppkey % 7) AS service_unit_type,
       'CO-'||(s_suppkey % 7 % 3) AS company, 'WH-'||(s_suppkey % 7 % 3) AS warehouse FROM {supplier}
UNION ALL
SELECT DISTINCT 'PHARM-'||(s_suppkey % 10) AS name, 'Pharmacy' AS service_unit_type,
       'CO-'||(s_suppkey % 10 % 3) AS company, 'WH-'||(s_suppkey % 10 % 2) AS warehouse FROM {supplier}""",
    "healthcare_service_unit_type": """
SELECT DISTINCT 'HSUT-'||(s_suppkey % 7) AS name, 'GROUP-'||(s_suppkey % 7 % 3) AS item_group,
       'ITEM-'||(s_suppkey % 7) AS item, 1 AS is_service_chargeable,
       CASE WHEN s_suppkey % 7 < 4 THEN 1 ELSE 0 END AS is_consultancy_chargeable FROM {supplier}""",
    "item": """
SELECT 'ITEM-'||p_partkey AS item_code, 'NAME-'||(p_partkey - p_partkey % 2) AS item_name, p_name AS description,
       p_type AS item_group, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS is_stock_item FROM {part}""",
    "item_rate": f"""
SELECT DISTINCT 'ITEM-'||k.item_no AS item_code, 'CO-'||(c_custkey % 3) AS company, {_SUBSCRIPTION} AS insurance_subscription,
       {_INSURER} AS insurance_company, p_retailprice AS rate
FROM (SELECT o_custkey AS cust, o_orderkey % 200 AS item_no FROM {{orders}}
      UNION SELECT o_custkey AS cust, l_suppkey % 7 AS item_no FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
      WHERE o_orderpriority = '1-URGENT') k
JOIN {{customer}} ON c_custkey = k.cust JOIN {{part}} ON p_partkey = k.item_no WHERE k.item_no % 10 <> 6""",
    "item_customer_detail": """
SELECT 'ITEM-'||p_partkey AS parent, CASE WHEN p_partkey % 4 = 0 THEN 'NHIF' WHEN p_partkey % 4 = 1 THEN NULL ELSE 'INS-A' END AS customer_name,
       CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN NULL ELSE 'REF-'||p_partkey END AS ref_code FROM {part}
UNION ALL
SELECT 'ITEM-'||p_partkey AS parent, 'INS-B' AS customer_name, 'RB-'||p_partkey AS ref_code FROM {part} WHERE p_partkey % 3 = 0""",
    "sales_invoice": """
SELECT 'SI-'||o_orderkey AS name, 'CO-'||(o_custkey % 3) AS company, CAST(o_orderdate AS date) AS posting_date,
       CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS is_pos,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN '' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'PT-'||o_custkey END AS patient,
       CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS enabled_auto_create_delivery_notes FROM {orders}""",
    "sales_invoice_item": _invoice_columns(
        "'SI-'||l_orderkey", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    ) + "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "sales_order": """
SELECT 'SO-'||o_orderkey AS name, 'CO-'||(o_custkey % 3) AS company, 'WH-'||(o_orderkey % 3) AS set_warehouse,
       'HP-'||(o_orderkey % 110) AS healthcare_practitioner,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'HSU-'||(o_orderkey % 7) END AS healthcare_service_unit,
       'DEP-'||(o_orderkey % 4) AS department FROM {orders}""",
    "sales_order_item": f"""
SELECT 'SOI-'||{_ROW} AS name, 'SO-'||l_orderkey AS parent,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS idx,
       'ITEM-'||l_partkey AS item_code, l_quantity AS qty,
       CASE WHEN l_partkey % 2 = 0 THEN 'Drug Prescription' ELSE NULL END AS reference_dt, 'RX-'||{_ROW} AS reference_dn,
       CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 4 = 1 THEN '' ELSE 'frequency: 1 x 2' END AS dosage_info
FROM {{lineitem}}""",
    "delivery_note": """
SELECT 'DN-'||o_orderkey AS name, 'CO-'||(o_custkey % 3) AS company,
       CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE 'PT-'||o_custkey END AS patient,
       CASE WHEN o_orderkey % 10 = 3 THEN '' ELSE 'SI-'||o_orderkey END AS form_sales_invoice,
       CASE WHEN o_orderkey % 10 = 5 THEN NULL ELSE 'ENC-'||o_orderkey END AS reference_name,
       'WH-'||(o_orderkey % 3) AS set_warehouse FROM {orders} WHERE o_orderkey % 2 = 1""",
    "delivery_note_item": f"""
SELECT 'DNI-'||{_ROW} AS name, 'DN-'||l_orderkey AS parent, l_linenumber AS idx,
       'ITEM-'||(CASE WHEN l_suppkey % 11 = 0 THEN l_partkey ELSE l_partkey - l_partkey % 5 + 3 END) AS item_code,
       l_quantity AS qty, l_extendedprice AS rate,
       CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'plain text'
            WHEN 2 THEN 'frequency: '||l_linenumber||' x 1, <br>period: 3 days, <br>dosage_form: Drops, <br>interval: 8'
            WHEN 3 THEN 'frequency: 2 x 2, '||chr(10)||'period: '||chr(10)||'5 days, '||chr(10)||'interval: , '||chr(10)||'interval_uom: Hour'||chr(10)||'Doctor''s comment: after food '
            ELSE 'frequency:   ' END AS description,
       CASE WHEN l_suppkey % 2 = 0 THEN 'SII-'||{_ROW} WHEN l_suppkey % 3 = 0 THEN '' ELSE NULL END AS si_detail,
       CASE WHEN l_linenumber % 3 = 0 THEN 'ENC-'||l_orderkey WHEN l_linenumber % 3 = 1 THEN '' ELSE NULL END AS reference_name
FROM {{lineitem}} WHERE l_orderkey % 2 = 1""",
    "stock_ledger_entry": """
SELECT 'SLE-'||event_id AS name, 'ITEM-'||user_id AS item_code, 'WH-'||(event_id % 3) AS warehouse,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS qty_after_transaction,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_cancelled, CAST(ts AS date) AS creation FROM {events}""",
    "codification_table": f"""
SELECT 'CT-'||{_ROW} AS name, 'ENC-'||l_orderkey AS parent, 'Patient Encounter' AS parenttype, l_linenumber AS idx,
       CASE WHEN l_returnflag = 'N' THEN 'patient_encounter_preliminary_diagnosis' ELSE 'patient_encounter_final_diagnosis' END AS parentfield,
       'ICD-'||(l_partkey % 9) AS medical_code,
       CASE l_partkey % 9 WHEN 0 THEN 'E119' WHEN 1 THEN 'E11.9' WHEN 2 THEN 'A01' WHEN 3 THEN 'E11.901'
            WHEN 4 THEN 'J45909' WHEN 5 THEN 'I10' WHEN 6 THEN 'B5.1' WHEN 7 THEN NULL ELSE 'Z001' END AS code,
       'Diagnosis '||(l_partkey % 9)||' '||repeat('x', CAST(l_partkey % 150 AS int)) AS description,
       l_shipdate + INTERVAL '7' HOUR AS modified FROM {{lineitem}}""",
    "insurance_claim": f"""
SELECT {_claim('o_orderkey')} AS name, 'APP-'||o_orderkey AS patient_appointment, 'PT-'||o_custkey AS patient,
       CASE WHEN o_orderkey % 56 = 0 THEN NULL WHEN o_orderkey % 26 = 0 THEN '' WHEN o_orderkey % 22 = 0 THEN 'CARD-X ' ELSE 'CARD-'||o_custkey END AS cardno,
       CASE WHEN o_orderkey % 34 = 0 THEN NULL ELSE 'PLAN-'||c_mktsegment END AS coverage_plan_name, 'CO-'||(o_custkey % 3) AS company,
       CAST(date_trunc('month', o_orderdate) AS date) AS attendance_date,
       CASE WHEN o_orderkey % 12 = 0 THEN '["APP-'||o_orderkey||'","APP-'||(o_orderkey + 2)||'"]'
            WHEN o_orderkey % 12 = 4 THEN '' WHEN o_orderkey % 12 = 8 THEN '[]' ELSE NULL END AS claim_appointment_list,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS docstatus,
       CASE WHEN o_orderkey % 14 = 0 THEN 'Unclaimable' ELSE 'Draft' END AS workflow_state,
       'AUTH-'||(o_orderkey - o_orderkey % 37 % 2) AS authorization_no,
       CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice ELSE coalesce(s.total, 0.0) END AS total_amount,
       CASE WHEN o_orderkey % 8 = 0 THEN 'FOLIO-'||o_orderkey ELSE NULL END AS folio_id,
       CASE WHEN o_orderkey % 16 = 0 THEN 'SIG' ELSE NULL END AS patient_signature, 0 AS allow_changes,
       CASE WHEN o_orderkey % 18 = 0 THEN 'late' ELSE NULL END AS delayreason, 'Clerk '||(o_orderkey % 7) AS item_crt_by,
       o_orderdate + INTERVAL '20' HOUR AS creation
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(({_CLAIMED_PRICE}) * l_quantity AS decimal(18,4))) AS double) AS total
           FROM {{lineitem}} WHERE l_returnflag <> 'R' GROUP BY l_orderkey) s ON s.l_orderkey = o_orderkey
WHERE o_orderkey % 2 = 0
UNION ALL
SELECT {_claim('900000000 + o_orderkey')} AS name, 'APP-'||o_orderkey AS patient_appointment, 'PT-'||o_custkey AS patient,
       CASE WHEN o_orderkey % 56 = 0 THEN NULL ELSE 'CARD-'||o_custkey END AS cardno,
       CASE WHEN o_orderkey % 34 = 0 THEN NULL ELSE 'PLAN-'||c_mktsegment END AS coverage_plan_name, 'CO-'||(o_custkey % 3) AS company,
       CAST(date_trunc('month', o_orderdate) AS date) AS attendance_date, CAST(NULL AS string) AS claim_appointment_list,
       0 AS docstatus, 'Unclaimable' AS workflow_state, 'AUTH-'||o_orderkey AS authorization_no, 0.0 AS total_amount,
       CAST(NULL AS string) AS folio_id, CAST(NULL AS string) AS patient_signature, 0 AS allow_changes,
       CAST(NULL AS string) AS delayreason, 'Clerk' AS item_crt_by, o_orderdate + INTERVAL '21' HOUR AS creation
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey WHERE o_orderkey % 28 = 0""",
    **{name: _claim_row(*how) for name, how in _CLAIM_ROWS.items()},
    "medication_return": f"""
SELECT 'RX-'||{_ROW} AS child_name, 'ENC-'||l_orderkey AS encounter_no, 'drug_items' AS parentfield,
       'LRPMT Returns' AS parenttype, 'RET-'||l_orderkey AS parent
FROM {{lineitem}} WHERE l_partkey % 5 = 3 AND l_tax >= 0.065 AND l_suppkey % 2 = 0""",
    "item_return": f"""
SELECT 'RX-'||{_ROW} AS child_name, 'ENC-'||l_orderkey AS encounter_no, 'lrpt_items' AS parentfield,
       'LRPMT Returns' AS parenttype, 'RET-'||l_orderkey AS parent
FROM {{lineitem}} WHERE l_partkey % 5 <> 3 AND l_tax >= 0.065 AND l_suppkey % 2 = 0""",
    "lrpmt_returns": """
SELECT 'RET-'||o_orderkey AS name, 'PT-'||o_custkey AS patient, 'APP-'||o_orderkey AS appointment,
       CAST(o_orderkey % 3 AS int) AS docstatus FROM {orders} WHERE o_orderkey % 6 < 4
UNION ALL
SELECT 'RET2-'||o_orderkey AS name, 'PT-'||o_custkey AS patient, 'APP-'||o_orderkey AS appointment,
       1 AS docstatus FROM {orders} WHERE o_orderkey % 4 = 0""",
    "medication_change_request": """
SELECT 'MCR-'||o_orderkey AS name, 'ENC-'||o_orderkey AS patient_encounter FROM {orders} WHERE o_orderkey % 4 = 0
UNION ALL
SELECT 'MCR-B'||o_orderkey AS name, 'ENC-'||o_orderkey AS patient_encounter FROM {orders} WHERE o_orderkey % 8 = 0""",
    "medication_change_request_drug": """
SELECT DISTINCT 'MCR-'||l_orderkey AS parent, 'Service '||(l_partkey % 6) AS drug_name, 'Medication Change Request' AS parenttype,
       CASE WHEN l_orderkey % 9 = 0 THEN 'drug_prescription' ELSE 'original_pharmacy_prescription' END AS parentfield
FROM {lineitem} WHERE l_orderkey % 4 = 0
UNION ALL
SELECT 'MCR-B'||o_orderkey AS parent, 'Service 3' AS drug_name, 'Medication Change Request' AS parenttype,
       'original_pharmacy_prescription' AS parentfield FROM {orders} WHERE o_orderkey % 8 = 0""",
    "mode_of_payment": """
SELECT DISTINCT 'MOP-'||(o_orderkey % 4) AS name,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'PL-'||(o_orderkey % 4) END AS price_list FROM {orders}""",
    "company": """
SELECT 'CO-'||n_nationkey AS name, CASE WHEN n_nationkey = 2 THEN NULL ELSE 'PL-CO-'||n_nationkey END AS default_price_list
FROM {nation} WHERE n_nationkey < 3""",
    "company_warehouse": """
SELECT 'CO-'||n_nationkey AS company, 'WH-'||n_nationkey AS warehouse FROM {nation} WHERE n_nationkey < 2""",
    "company_claim_settings": """
SELECT 'CO-'||n_nationkey AS company, 'FAC-'||n_nationkey AS facility_code,
       CASE WHEN n_nationkey = 2 THEN NULL ELSE 5 END AS submit_claim_month,
       CASE WHEN n_nationkey = 2 THEN NULL ELSE 1998 END AS submit_claim_year FROM {nation} WHERE n_nationkey < 3""",
    "folio_counter": """
SELECT DISTINCT 'CO-'||(o_custkey % 3) AS company, CAST(year(o_orderdate) AS int) AS claim_year,
       CAST(month(o_orderdate) AS int) AS claim_month, CAST(100 + month(o_orderdate) AS int) AS folio_no
FROM {orders} WHERE month(o_orderdate) % 2 = 0""",
}


#: What Spark reads instead of the text of ``DERIVED``.
DEALT = {name: _dealt_claim_row(*how) for name, how in _CLAIM_ROWS.items()} | {
    "sales_invoice_item": _invoice_columns("l_invoice", "l_row_no")
    + """FROM (SELECT *, row_number() OVER (PARTITION BY l_invoice ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_row_no
      FROM (SELECT *, 'SI-'||l_orderkey AS l_invoice FROM {lineitem} JOIN {part} ON l_partkey = p_partkey))""",
}


def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The hospital tables over one folder of test tables."""
    base: dict[str, DataFrame] = {}

    def open_table(name: str) -> DataFrame:
        if name not in base:
            base[name] = spark.read.schema(TEST_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")
        return base[name]

    def load(name: str) -> DataFrame:
        text = DEALT.get(name, DERIVED[name])
        used = {k: open_table(k) for k in TEST_TABLES if "{" + k + "}" in text}
        return conform(spark.sql(text, **used), name)

    return Tables(load)


def derived_cte(name: str) -> str:
    """The same SELECT for an engine in which the test tables are views."""
    return DERIVED[name].format(**{t: t for t in TEST_TABLES})
