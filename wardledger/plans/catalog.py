"""The registered queries: each operator over the derived hospital tables of one folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardledger.operators import claim_changes as G
from wardledger.operators import claim_checks as V
from wardledger.operators import claim_diseases as D
from wardledger.operators import claim_header as H
from wardledger.operators import claim_items as C
from wardledger.operators import claim_notes as N
from wardledger.operators import claim_reconcile as M
from wardledger.operators import delivery as L
from wardledger.operators import orders as O
from wardledger.operators import prescriptions as P
from wardledger.operators import revenue as R
from wardledger.operators import stock as S
from wardledger.operators.claim_frame import ClaimFrame
from wardledger.options import ReportFilters, RunContext
from wardledger.plans import revenue_report as report
from wardledger.plans.claim_build import BuiltClaims, build_claims, merge_leads, rebuild_merged_claims
from wardledger.sources.derived import derived_tables
from wardledger.sources.tables import Tables

FILTERS = ReportFilters(dt.date(1996, 1, 1), dt.date(1999, 12, 31), "CO-0")
OPEN_FILTERS = ReportFilters(from_date=dt.date(1997, 1, 1))
RUN = RunContext(dt.datetime(2002, 3, 4, 5, 6, 7))


def _headers(t: Tables) -> DataFrame:
    return H.claim_headers(t.insurance_claim, t, RUN)


def _periods(t: Tables) -> DataFrame:
    return H.claim_periods(t.insurance_claim, t, RUN)


def _records(t: Tables) -> DataFrame:
    return H.claim_inpatient_record(H.final_encounters(t.insurance_claim, t))


def _rated_lines(t: Tables) -> DataFrame:
    claims, records = t.insurance_claim, _records(t)
    beds = C.bed_lines(C.inpatient_claims(claims, records, t), t)
    return beds.unionByName(C.consultation_lines(claims, records, t))


def _notes(t: Tables) -> DataFrame:
    frame = ClaimFrame(t.insurance_claim, t, keep=("visits",))
    return N.clinical_notes(frame, H.claim_patients_of(frame), RUN)


def _folios(t: Tables) -> DataFrame:
    return build_claims(t.insurance_claim, t, RUN).documents


# Fields of a folio document that are compared one by one, and those of its disease and item rows.
FOLIO_TEXTS = (
    "BillNo", "FolioNo", "SerialNo", "ClaimYear", "ClaimMonth", "FacilityCode", "CardNo", "FirstName", "LastName", "Gender",
    "DateOfBirth", "PatientFileNo", "ClaimFile", "ClinicalNotes", "AuthorizationNo", "AttendanceDate", "PatientTypeCode",
    "DateAdmitted", "DateDischarged", "PractitionerName", "PractitionerNo", "CreatedBy", "DateCreated",
    "LateSubmissionReason", "PatientFile",
)
DISEASE_TEXTS = ("Status", "DiseaseCode", "Remarks", "CreatedBy", "DateCreated")
ITEM_TEXTS = ("ItemCode", "ItemQuantity", "UnitPrice", "AmountClaimed", "ApprovalRefNo", "CreatedBy", "DateCreated")


def _folio_fields(folios: DataFrame) -> DataFrame:
    """The whole documents read back, so that both engines can be compared: a column per field, rows as joined text."""

    def kind(name: str) -> str:
        return "decimal(18,4)" if name in ("UnitPrice", "AmountClaimed") else "string"

    def struct(names: tuple[str, ...]) -> str:
        return "array<struct<" + ", ".join(f"{n}: {kind(n)}" for n in names) + ">>"

    fields = ", ".join(f"{n}: string" for n in FOLIO_TEXTS)
    schema = f"entities array<struct<{fields}, FolioDiseases: {struct(DISEASE_TEXTS)}, FolioItems: {struct(ITEM_TEXTS)}>>"
    e = F.col("entity")

    def rows(array: str, names: tuple[str, ...]):
        text = lambda x: F.concat_ws("|", *[F.coalesce(x[n].cast("string"), F.lit("null")) for n in names])
        return F.array_join(F.transform(e[array], text), ",")

    parsed = folios.withColumn("entity", F.from_json("folio_json", schema)["entities"][0])
    keys = F.json_object_keys(F.get_json_object("folio_json", "$.entities[0]"))
    return parsed.select(
        "claim",
        F.array_join(keys, ",").alias("keys"),
        *[e[n].alias(n.lower()) for n in FOLIO_TEXTS],
        F.size(e["FolioDiseases"]).alias("diseases"),
        rows("FolioDiseases", DISEASE_TEXTS).alias("disease_rows"),
        F.size(e["FolioItems"]).alias("items"),
        rows("FolioItems", ITEM_TEXTS).alias("item_rows"),
    )


def _rebuilt(t: Tables) -> BuiltClaims:
    return rebuild_merged_claims(t.insurance_claim, t, RUN)


def _originals(t: Tables) -> DataFrame:
    return M.reconcile_items(t.original_claim_item)


def _removed(t: Tables) -> DataFrame:
    return G.removed_originals(_originals(t), t.claim_item)


def _removed_names(t: Tables) -> DataFrame:
    return G.removed_names(G.marked_originals(_originals(t), t.claim_item))


def _delivered(t: Tables) -> Tables:
    """Deliveries after their descriptions were filled from the invoices."""
    return t.with_tables(delivery_note_item=S.with_invoice_dosage(t))


PLANS: dict[str, Callable[[Tables], DataFrame]] = {
    "r1_consultation_revenue": lambda t: R.consultation_revenue(t, FILTERS),
    "r2_lab_revenue": lambda t: R.lab_revenue(t, FILTERS),
    "r3_radiology_revenue": lambda t: R.radiology_revenue(t, FILTERS),
    "r4_procedure_revenue": lambda t: R.procedure_revenue(t, FILTERS),
    "r5_drug_revenue": lambda t: R.drug_revenue(t, FILTERS),
    "r6_therapy_revenue": lambda t: R.therapy_revenue(t, FILTERS),
    "r7_bed_revenue": lambda t: R.bed_revenue(t, FILTERS),
    "r8_consultancy_revenue": lambda t: R.consultancy_revenue(t, FILTERS),
    "r9_report_filters": lambda t: R.prescription_revenue(t, OPEN_FILTERS),
    "r10_revenue_report": lambda t: report.revenue_report(t, FILTERS),
    "r10_report_with_cash": lambda t: report.revenue_report(t, FILTERS, include_cash=True),
    "r11_report_total": lambda t: report.report_with_total(report.revenue_report(t, FILTERS)),
    "r12_cash_revenue": lambda t: R.cash_revenue(t, FILTERS),
    "h1_claim_appointments": lambda t: H.claim_appointments(t.insurance_claim),
    "h2_claim_encounters": lambda t: H.claim_encounters(t.insurance_claim, t),
    "h3_final_encounters": lambda t: H.final_encounters_ranked(t.insurance_claim, t),
    "h4_claim_practitioners": lambda t: H.claim_practitioners(H.final_encounters(t.insurance_claim, t), t),
    "h5_claim_inpatient_record": lambda t: H.claim_inpatient_record(H.final_encounters(t.insurance_claim, t)),
    "h6_claim_stays": lambda t: H.claim_stays(t.insurance_claim, t, RUN),
    "h7_claim_period": lambda t: _periods(t).select(F.col("name").alias("claim"), "claim_year", "claim_month"),
    "h8_claim_headers": lambda t: _headers(t),
    "h9_folio_numbers": lambda t: H.folio_numbers(_periods(t), t.folio_counter)[0],
    "h9_folio_counters": lambda t: H.folio_counters(_periods(t), t.folio_counter),
    "h10_eligible_appointments": lambda t: H.eligible_appointments(t).select(
        "name", "patient", "insurance_company", "insurance_subscription", "nhif_patient_claim"
    ),
    "h11_link_appointments": lambda t: H.link_appointments(t.patient_appointment, t.insurance_claim).select(
        "name", "nhif_patient_claim"
    ),
    "h11_unlink_deleted_claims": lambda t: H.unlink_deleted_claims(
        t.patient_appointment, t.insurance_claim.filter(F.col("docstatus") == 0)
    ).select("name", "nhif_patient_claim"),
    "h12_claims_with_returns": lambda t: H.claims_with_returns(t.insurance_claim, t),
    "c1_claim_diseases": lambda t: D.claim_diseases(t.insurance_claim, t),
    "c2_disease_codes": lambda t: D.normalized_codes(t.codification_table),
    "c2_missing_codes": lambda t: D.missing_code_violations(t.insurance_claim, t),
    "c3_prescriptions": lambda t: P.prescriptions(t),
    "c4_outpatient_lines": lambda t: C.outpatient_lines(t.insurance_claim, _records(t), t).select(*C.LINE_COLUMNS),
    "c5_inpatient_lines": lambda t: C.inpatient_lines(t.insurance_claim, _records(t), t).select(*C.LINE_COLUMNS),
    "c6_consultation_lines": lambda t: C.consultation_lines(t.insurance_claim, _records(t), t).select(*C.LINE_COLUMNS),
    "c7_item_status": lambda t: P.with_status(P.prescriptions(t), t).select("name", "ref_doctype", "status"),
    "c8_rated_lines": lambda t: _rated_lines(t).select(*C.LINE_COLUMNS),
    "c8_price_violations": lambda t: C.price_violations(_rated_lines(t)),
    "c9_claim_lines": lambda t: C.claim_lines(t.insurance_claim, t),
    "c10_completed_items": lambda t: C.completed_items(t.claim_item, _headers(t), RUN),
    "c10_claim_totals": lambda t: C.claim_totals(t.claim_item),
    "c10_completed_diseases": lambda t: C.completed_diseases(D.claim_diseases(t.insurance_claim, t), _headers(t), RUN),
    "c10_saved_headers": lambda t: build_claims(t.insurance_claim, t, RUN).saved_headers,
    "c11_clinical_notes": lambda t: _notes(t),
    "c11_missing_examination": lambda t: N.missing_examination(t.insurance_claim, t),
    "c12_folio_documents": lambda t: _folio_fields(_folios(t)),
    "c13_item_reference_codes": lambda t: C.item_reference_codes(t),
    "c13_missing_reference_codes": lambda t: C.reference_code_violations(t),
    "m1_reconciled_items": lambda t: M.reconcile_items(t.claim_item, recompute_amount=True),
    "m1_reconciled_originals": lambda t: M.reconcile_items(t.original_claim_item),
    "m2_merged_claims": lambda t: M.mergeable_claims(t.insurance_claim),
    "m2_single_claims": lambda t: M.single_claim_violations(t.insurance_claim),
    "m2_rebuilt_claims": lambda t: _rebuilt(t).saved_headers,
    "m2_rebuilt_lines": lambda t: _rebuilt(t).lines,
    "m2_relinked_appointments": lambda t: H.link_appointments(
        t.patient_appointment, merge_leads(t.insurance_claim)
    ).select("name", "nhif_patient_claim"),
    "m3_original_snapshot": lambda t: M.original_snapshot(t.claim_item),
    "m4_missing_originals": lambda t: M.missing_originals(t.claim_item, t.original_claim_item),
    "m4_missing_originals_by_name": lambda t: M.missing_originals(
        M.reconcile_items(t.claim_item, recompute_amount=True), t.original_claim_item, token_match=True
    ),
    "t1_amount_changes": lambda t: G.amount_changes(_originals(t), t.claim_item),
    "t2_removed_originals": lambda t: _removed(t).select(
        "claim", "idx", "item_code", "ref_doctype", "ref_docname", F.col("current_amount").alias("amount_claimed")
    ),
    "t2_removed_appointments": lambda t: G.removed_appointments(_removed(t)),
    "t3_drug_removals": lambda t: G.drug_removals(_removed_names(t), t),
    "t4_service_removals": lambda t: G.service_removals(_removed_names(t), t),
    "t4_unknown_prescriptions": lambda t: G.unknown_service_violations(_removed_names(t), t),
    "t5_stay_removals": lambda t: G.stay_removals(_removed_names(t), t),
    "t6_change_requests": lambda t: G.change_requests(t),
    "t7_change_records": lambda t: G.track_changes(
        _originals(t), t.claim_item, _periods(t), t, RUN
    ),
    "v1_without_encounters": lambda t: V.without_encounters(t.insurance_claim, t),
    "v2_without_final_encounters": lambda t: V.without_final_encounters(t.insurance_claim, t),
    "v3_practitioners": lambda t: V.practitioner_violations(t.insurance_claim, t),
    "v3_left_out_codes": lambda t: H.header_violations(t.insurance_claim, t),
    "v4_without_rows": lambda t: V.without_rows(t.insurance_claim, D.claim_diseases(t.insurance_claim, t), t.claim_item),
    "v5_total_amount": lambda t: V.total_violations(t.insurance_claim, t.claim_item),
    "v6_draft_items": lambda t: V.draft_items(t.claim_item),
    "v7_appointment_mismatches": lambda t: V.appointment_mismatches(t.insurance_claim, t),
    "v8_other_insurers": lambda t: V.other_insurer_claims(t.insurance_claim, t),
    "v9_duplicate_drafts": lambda t: V.duplicate_drafts(t.insurance_claim),
    "v10_submission_period": lambda t: V.submission_period_violations(_headers(t), t),
    "v11_missing_signatures": lambda t: V.missing_signatures(_headers(t), t),
    "v12_merge_needed": lambda t: V.merge_needed(t.insurance_claim, t),
    "v13_card_decisions": lambda t: V.card_decisions(t.insurance_claim, t),
    "v_claim_violations": lambda t: V.claim_violations(t.insurance_claim, t.claim_item, t, RUN),
    "s1_order_encounters": lambda t: O.order_encounters(t).select("name", "inpatient_record", "insurance_subscription"),
    "s2_order_lines": lambda t: O.order_lines(O.order_encounters(t), t, RUN).drop("dosage_info"),
    "s3_dosage_text": lambda t: O.order_lines(O.order_encounters(t), t, RUN)
    .filter(F.col("category") == "drug")
    .select("reference_dn", "dosage_info"),
    "s4_order_headers": lambda t: O.order_headers(
        O.order_encounters(t), O.order_lines(O.order_encounters(t), t, RUN), t, RUN
    ),
    "s4_order_violations": lambda t: O.order_violations(
        O.order_encounters(t), O.order_lines(O.order_encounters(t), t, RUN), t
    ),
    "s5_dosage_template": lambda t: O.with_dosage_template(t.sales_order_item, t),
    "s6_stock_on_hand": lambda t: S.stock_on_hand(t),
    "s7_order_stock_validate": lambda t: S.order_stock_checks(t, "validate"),
    "s7_order_stock_submit": lambda t: S.order_stock_checks(t, "before_submit"),
    "s8_invoice_stock_validate": lambda t: S.invoice_stock_checks(t, "validate"),
    "s8_invoice_stock_submit": lambda t: S.invoice_stock_checks(t, "before_submit"),
    "s9_order_dimensions": lambda t: S.with_order_dimensions(t),
    "s10_invoice_dosage": lambda t: S.with_invoice_dosage(t).select("name", "parent", "item_code", "description"),
    "s11_dosage_fields": lambda t: L.dosage_or_default(S.with_invoice_dosage(t), t).select(
        "name", "drug_code", "dosage", "period", "dosage_form", "interval", "interval_uom", "comment"
    ),
    "s12_dispensed_prescriptions": lambda t: L.dispensed_prescriptions(L.accepted_items(_delivered(t)), t),
    "s12_dispensing_violations": lambda t: L.dispensing_violations(_delivered(t)),
    "s13_updated_prescriptions": lambda t: L.updated_prescriptions(_delivered(t)),
}


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates and datetimes as text, so that both engines print them alike."""
    return df.selectExpr(
        *[
            f"cast(`{f.name}` as string) as `{f.name}`"
            if isinstance(f.dataType, (T.DateType, T.TimestampNTZType))
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: dates_as_text(plan(derived_tables(spark, sf_dir)))

    return {name: bind(plan) for name, plan in PLANS.items()}
