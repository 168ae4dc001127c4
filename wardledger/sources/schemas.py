"""Declared schemas of the input and output tables. Nothing is inferred.

Money is ``double`` as stored and is summed as ``decimal(18,4)``; check fields and ``docstatus``
(0 draft, 1 submitted, 2 cancelled) are ``int``; times of day are ``HH:mm:ss`` text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(), "boolean": T.BooleanType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(text: str) -> T.StructType:
    fields = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


_INPUTS = {
    "healthcare_practitioner": """
        name string, practitioner_name string, healthcare_practitioner_type string, department
        string, tz_mct_code string""",
    "medical_department": """
        name string, main_department string""",
    "patient": """
        name string, customer string, mobile string, patient_name string, first_name string,
        last_name string, dob date, sex string, patient_signature string""",
    "patient_appointment": """
        name string, patient string, practitioner string, appointment_date date, appointment_time
        string, company string, status string, insurance_subscription string, insurance_company
        string, coverage_plan_name string, coverage_plan_card_number string, authorization_number
        string, follow_up int, paid_amount double, service_unit string, billing_item string,
        has_no_consultation_charges int, nhif_patient_claim string, creation timestamp_ntz,
        modified timestamp_ntz""",
    "patient_encounter": """
        name string, appointment string, practitioner string, practitioner_name string,
        encounter_date date, encounter_time string, company string, docstatus int, encounter_type
        string, duplicated int, inpatient_record string, insurance_subscription string,
        insurance_company string, insurance_coverage_plan string, healthcare_service_unit string,
        examination_detail string, patient string, patient_name string, mode_of_payment string,
        creation timestamp_ntz, modified timestamp_ntz""",
    "lab_prescription": """
        name string, parent string, idx int, lab_test_code string, lab_test_name string,
        department_hsu string, lab_test string, is_cancelled int, prescribe int,
        is_not_available_inhouse int, amount double, modified timestamp_ntz""",
    "radiology_prescription": """
        name string, parent string, idx int, radiology_examination_template string,
        radiology_procedure_name string, department_hsu string, radiology_examination string,
        is_cancelled int, prescribe int, is_not_available_inhouse int, amount double, modified
        timestamp_ntz""",
    "procedure_prescription": """
        name string, parent string, idx int, procedure string, procedure_name string,
        department_hsu string, clinical_procedure string, is_cancelled int, prescribe int,
        is_not_available_inhouse int, amount double, modified timestamp_ntz""",
    "drug_prescription": """
        name string, parent string, idx int, drug_code string, drug_name string,
        healthcare_service_unit string, dn_detail string, quantity double, quantity_returned
        double, dosage string, period string, dosage_form string, interval string, interval_uom
        string, medical_code string, comment string, is_cancelled int, prescribe int,
        is_not_available_inhouse int, amount double, modified timestamp_ntz""",
    "therapy_plan_detail": """
        name string, parent string, idx int, therapy_type string, department_hsu string,
        is_cancelled int, prescribe int, is_not_available_inhouse int, amount double, modified
        timestamp_ntz""",
    "lab_test": """
        name string, docstatus int, ref_docname string, ref_doctype string, ref_childname string,
        workflow_state string""",
    "radiology_examination": """
        name string, docstatus int""",
    "clinical_procedure": """
        name string, docstatus int""",
    "approval": """
        ref_doctype string, ref_docname string, approval_number string""",
    "item_template": """
        template_type string, name string, item string""",
    "medication": """
        name string, item string, medication_name string, default_interval string,
        default_interval_uom string, default_prescription_duration string, default_dosage_form
        string, default_prescription_dosage string, default_comments string""",
    "inpatient_record": """
        name string, patient_appointment string, company string, insurance_subscription string,
        scheduled_date date, admitted_datetime timestamp_ntz, discharge_date date, creation
        timestamp_ntz, admission_encounter string""",
    "inpatient_occupancy": """
        name string, parent string, idx int, check_in timestamp_ntz, service_unit string,
        is_confirmed int, amount double, modified timestamp_ntz, modified_by string""",
    "inpatient_consultancy": """
        name string, parent string, idx int, date date, consultation_item string, rate double,
        encounter string, is_confirmed int, healthcare_practitioner string, modified timestamp_ntz""",
    "healthcare_service_unit": """
        name string, service_unit_type string, company string, warehouse string""",
    "healthcare_service_unit_type": """
        name string, item_group string, item string, is_service_chargeable int,
        is_consultancy_chargeable int""",
    "item": """
        item_code string, item_name string, description string, item_group string, is_stock_item
        int""",
    "item_rate": """
        item_code string, company string, insurance_subscription string, insurance_company string,
        rate double""",
    "item_customer_detail": """
        parent string, customer_name string, ref_code string""",
    "sales_invoice": """
        name string, company string, posting_date date, is_pos int, patient string,
        enabled_auto_create_delivery_notes int""",
    "sales_invoice_item": """
        name string, parent string, idx int, docstatus int, item_code string, item_group string,
        qty double, amount double, warehouse string, healthcare_practitioner string,
        healthcare_service_unit string, department string, sales_order string, reference_dt
        string, dosage_info string""",
    "sales_order": """
        name string, company string, set_warehouse string, healthcare_practitioner string,
        healthcare_service_unit string, department string""",
    "sales_order_item": """
        name string, parent string, idx int, item_code string, qty double, reference_dt string,
        reference_dn string, dosage_info string""",
    "delivery_note": """
        name string, company string, patient string, form_sales_invoice string, reference_name
        string, set_warehouse string""",
    "delivery_note_item": """
        name string, parent string, idx int, item_code string, qty double, rate double,
        description string, si_detail string, reference_name string""",
    "stock_ledger_entry": """
        name string, item_code string, warehouse string, qty_after_transaction double,
        is_cancelled int, creation timestamp_ntz""",
    "codification_table": """
        name string, parent string, parenttype string, idx int, parentfield string, medical_code
        string, code string, description string, modified timestamp_ntz""",
    "insurance_claim": """
        name string, patient_appointment string, patient string, cardno string, coverage_plan_name
        string, company string, attendance_date date, claim_appointment_list string, docstatus
        int, workflow_state string, authorization_no string, total_amount double, folio_id string,
        patient_signature string, allow_changes int, delayreason string, item_crt_by string,
        creation timestamp_ntz""",
    "original_claim_item": """
        name string, parent string, idx int, item_code string, item_name string, item_quantity
        int, unit_price double, amount_claimed double, ref_doctype string, ref_docname string,
        patient_encounter string, status string, approval_ref_no string, date_created date,
        folio_item_id string, folio_id string, item_crt_by string""",
    "claim_item": """
        name string, parent string, idx int, item_code string, item_name string, item_quantity
        int, unit_price double, amount_claimed double, ref_doctype string, ref_docname string,
        patient_encounter string, status string, approval_ref_no string, date_created date,
        folio_item_id string, folio_id string, item_crt_by string""",
    "medication_return": """
        child_name string, encounter_no string, parentfield string, parenttype string, parent
        string""",
    "item_return": """
        child_name string, encounter_no string, parentfield string, parenttype string, parent
        string""",
    "lrpmt_returns": """
        name string, patient string, appointment string, docstatus int""",
    "medication_change_request": """
        name string, patient_encounter string""",
    "medication_change_request_drug": """
        parent string, drug_name string, parenttype string, parentfield string""",
    "mode_of_payment": """
        name string, price_list string""",
    "company": """
        name string, default_price_list string""",
    "company_warehouse": """
        company string, warehouse string""",
    "company_claim_settings": """
        company string, facility_code string, submit_claim_month int, submit_claim_year int""",
    "folio_counter": """
        company string, claim_year int, claim_month int, folio_no int""",
}

SCHEMAS: dict[str, T.StructType] = {name: _struct(text) for name, text in _INPUTS.items()}

REVENUE = _struct(
    "year int, month string, healthcare_practitioner string, healthcare_practitioner_type string, "
    "practitioner_hsu string, department_hsu string, amount double, department string, "
    "payment_mode string, speciality string, main_department string, status string"
)

CLAIM_HEADER = _struct(
    "name string, patient_appointment string, patient string, patient_name string, first_name string, "
    "last_name string, telephone_no string, date_of_birth date, gender string, company string, "
    "posting_date date, inpatient_record string, cardno string, authorization_no string, "
    "coverage_plan_name string, patient_signature string, folio_id string, facility_code string, "
    "claim_year int, claim_month int, serial_no int, item_crt_by string, delayreason string, "
    "practitioner_name string, practitioner_no string, date_discharge date, discharge_time string, "
    "date_admitted date, admitted_time string, patient_type_code string, attendance_date date, "
    "attendance_time string, patient_file_no string, claim_appointment_list string, docstatus int, "
    "creation timestamp_ntz"
)

CLAIM_LINE = _struct(
    "claim string, item_name string, item_code string, item_quantity double, unit_price double, "
    "amount_claimed double, approval_ref_no string, status string, patient_encounter string, "
    "ref_doctype string, ref_docname string, date_created date, item_crt_by string"
)

CLAIM_DISEASE = _struct(
    "claim string, diagnosis_type string, status string, patient_encounter string, "
    "codification_table string, medical_code string, disease_code string, description string, "
    "item_crt_by string, date_created date"
)

CLAIM_CHANGE = _struct(
    "item_code string, item_name string, quantity int, claim_month int, claim_year int, company string, "
    "posting_date date, posting_time string, status string, previous_amount double, "
    "current_amount double, amount_changed double, insurance_claim string, patient_appointment string, "
    "ref_docname string, ref_doctype string, patient_encounter string, lrpmt_return string, "
    "medication_change_request string, user_email string, edited_by string"
)

#: The latest ledger entry of each item and warehouse, kept between runs.
STOCK_STATE = _struct(
    "item_code string, warehouse string, entry_creation timestamp_ntz, entry string, qty_after_transaction double, "
    "has_entry boolean, seen timestamp_ntz"
)


def shaped(df: DataFrame, schema: T.StructType, missing_as_null: bool = False) -> DataFrame:
    """The columns of a schema, in its order and types."""
    have = set(df.columns) if missing_as_null else {f.name for f in schema.fields}
    return df.selectExpr(
        *[
            f"cast({f'`{f.name}`' if f.name in have else 'null'} as {f.dataType.simpleString()}) as `{f.name}`"
            for f in schema.fields
        ]
    )
