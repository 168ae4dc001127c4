"""Claim validation: one row per (claim, rule, detail) instead of stopping at the first error.

A rule is a condition on a claim's facts. The facts of all rules are gathered side by side, so the whole
report reads the claims once; each rule can also be run alone on the facts it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import differs, is_blank, money, non_blank, violation
from wardledger.functions.joins import join_null_safe, spread_blank, spread_null
from wardledger.operators import claim_diseases as D
from wardledger.operators import claim_header as H
from wardledger.options import RunContext
from wardledger.sources.tables import Tables

# Insurers whose claims are made elsewhere.
OTHER_INSURERS = ("NHIF", "NHIF Town", "NHIF Upanga - RSPDC")

VISIT = ["patient", "attendance_date", "cardno", "coverage_plan_name"]
CLAIM_CARD = ["patient", "patient_appointment", "cardno"]


def _rows(claims: DataFrame) -> DataFrame:
    return claims.select(
        F.col("name").alias("claim"), *CLAIM_CARD, "attendance_date", "coverage_plan_name", "docstatus",
        "authorization_no", "total_amount",
    )


# Facts ---------------------------------------------------------------------------------------------------


def _encounter_facts(rows: DataFrame, claims: DataFrame, t: Tables) -> DataFrame:
    """encounters, final_encounters, and the first practitioner of the final ones."""
    people = t.healthcare_practitioner.select(
        F.col("name").alias("practitioner"), "practitioner_name", "tz_mct_code", F.lit(True).alias("known")
    )
    first = F.min(
        F.when(F.col("is_final") & F.col("known"), F.struct("practitioner", "practitioner_name", "tz_mct_code"))
    )
    facts = (
        H.submitted_encounters(claims, t)
        .join(people, "practitioner", "left")
        .groupBy("claim")
        .agg(
            F.count(F.lit(1)).alias("encounters"),
            F.count_if("is_final").alias("final_encounters"),
            first.alias("first"),
        )
    )
    return rows.join(facts, "claim", "left").fillna(0, ["encounters", "final_encounters"])


def _row_facts(rows: DataFrame, diseases: DataFrame, items: DataFrame) -> DataFrame:
    """disease_rows, item_rows and the items' exact total."""
    disease_counts = diseases.groupBy("claim").agg(F.count(F.lit(1)).alias("disease_rows"))
    item_counts = items.groupBy(F.col("parent").alias("claim")).agg(
        F.count(F.lit(1)).alias("item_rows"), F.sum(money("amount_claimed")).alias("item_total")
    )
    return (
        rows.join(disease_counts, "claim", "left")
        .join(item_counts, "claim", "left")
        .fillna(0, ["disease_rows", "item_rows"])
    )


def _appointment_facts(rows: DataFrame, t: Tables) -> DataFrame:
    appointments = t.patient_appointment.select(
        F.col("name").alias("patient_appointment"),
        "authorization_number",
        "coverage_plan_card_number",
        "insurance_company",
        F.lit(True).alias("has_appointment"),
    )
    return rows.join(appointments, "patient_appointment", "left")


def _draft_facts(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """drafts: how many drafts have the same patient, appointment and card, where more than one.

    The groups are counted first, so a claim is joined with its group's count, not its partners.
    """
    repeated = (
        claims.filter(F.col("docstatus") == 0)
        .groupBy(*CLAIM_CARD)
        .agg(F.count(F.lit(1)).alias("drafts"))
        .filter("drafts > 1")
    )
    return join_null_safe(rows, repeated, CLAIM_CARD, "left")


def _header_facts(headers: DataFrame, t: Tables) -> DataFrame:
    settings = t.company_claim_settings.select("company", "submit_claim_month", "submit_claim_year")
    return (
        headers.select(
            F.col("name").alias("claim"),
            F.col("patient").alias("header_patient"),
            "patient_signature",
            "company",
            "claim_year",
            "claim_month",
        )
        .join(settings, "company", "left")
        .drop("company")
    )


def _visit_facts(rows: DataFrame, claims: DataFrame, t: Tables) -> DataFrame:
    """The counts that decide about merging and about the patient's card.

    appointments: same patient, day, card and plan, not cancelled; open_claims: unclaimable drafts of
    the same patient, appointment and card; merged: the distinct appointments those list; merged_here:
    how many of ``appointments`` are among them. drafts: all drafts of the same patient, appointment and card.
    """
    appointments = t.patient_appointment.filter(differs("status", "Cancelled")).select(
        F.col("name").alias("appointment"),
        "patient",
        F.col("appointment_date").alias("attendance_date"),
        F.col("coverage_plan_card_number").alias("cardno"),
        "coverage_plan_name",
    )
    appointment_counts = appointments.groupBy(*VISIT).agg(F.count(F.lit(1)).alias("appointments"))
    drafts = claims.filter(F.col("docstatus") == 0)
    held = drafts.filter(F.col("workflow_state") == "Unclaimable")
    listed = held.select(
        *CLAIM_CARD, F.explode(F.from_json("claim_appointment_list", "array<string>")).alias("appointment")
    ).distinct()
    nothing = F.lit(0)
    per_card = (
        drafts.select(*CLAIM_CARD, F.lit(1).alias("d"), (F.col("workflow_state") == "Unclaimable").cast("int").alias("o"), nothing.alias("m"))
        .unionByName(listed.select(*CLAIM_CARD, nothing.alias("d"), nothing.alias("o"), F.lit(1).alias("m")))
        .groupBy(*CLAIM_CARD)
        .agg(F.sum("d").alias("drafts"), F.sum("o").alias("open_claims"), F.sum("m").alias("merged"))
    )
    here = (
        join_null_safe(listed, appointments, ["appointment", "patient", "cardno"])
        .groupBy(*CLAIM_CARD, "attendance_date", "coverage_plan_name")
        .agg(F.count(F.lit(1)).alias("merged_here"))
    )
    rows = join_null_safe(rows, appointment_counts, VISIT, "left")
    rows = join_null_safe(rows, per_card, CLAIM_CARD, "left")
    rows = join_null_safe(rows, here, [*CLAIM_CARD, "attendance_date", "coverage_plan_name"], "left")
    return rows.fillna(0, ["appointments", "drafts", "open_claims", "merged", "merged_here"])


def _tagged(df: DataFrame, **facts: Column) -> DataFrame:
    """One source's part of the facts of a claim; the parts of all sources have the same columns."""
    missing = {name: F.lit(None).cast(kind) for name, kind in _PARTS.items() if name not in facts}
    return df.select("claim", *[(facts | missing)[name].cast(kind).alias(name) for name, kind in _PARTS.items()])


# What a source can say of a claim: its kind of value, summed up by _GATHERED.
_PERSON = "struct<practitioner:string,practitioner_name:string,tz_mct_code:string>"
_STAY = "struct<scheduled_date:date,admitted_day:date,discharge_date:date,recorded:boolean>"
_OWN = (
    "struct<patient:string,company:string,appointment_date:date,authorization_number:string,"
    "coverage_plan_card_number:string,insurance_company:string>"
)
_CLAIM = (
    "struct<patient:string,patient_appointment:string,cardno:string,authorization_no:string,total_amount:double,"
    "docstatus:int,company:string,patient_signature:string,appointments:bigint,drafts:bigint,open_claims:bigint,"
    "merged:bigint,merged_here:bigint>"
)
_PARTS = {
    "row": _CLAIM,
    "own": _OWN,
    "visit": "int",
    "final": "int",
    "disease": "int",
    "person": _PERSON,
    "stay_order": "struct<modified:timestamp_ntz,encounter:string>",
    "stay": _STAY,
    "item": "int",
    "item_amount": "decimal(18,4)",
}


def _claim_part(claims: DataFrame, t: Tables) -> DataFrame:
    rows = claims.withColumn("claim", F.col("name"))
    counted = _visit_facts(rows, claims, t)
    names = [f.split(":")[0] for f in _CLAIM[7:-1].split(",")]
    return _tagged(counted, row=F.struct(*names))


def _care_part(claims: DataFrame, t: Tables) -> DataFrame:
    """Rows per claim and appointment, and per encounter of it: what appointment, practitioner, stay and diagnoses say."""
    listed = F.array_distinct(H.listed_appointments())
    own = F.col("patient_appointment")
    named = claims.select(F.col("name").alias("claim"), own.alias("own"), F.explode(F.array_union(listed, F.array(own))).alias("appointment"), listed.alias("_listed"))
    named = named.filter(~is_blank("appointment")).select(
        "claim", "appointment", (F.col("appointment") == F.col("own")).alias("is_own"), F.array_contains("_listed", F.col("appointment")).alias("is_listed")
    )
    appointments = t.patient_appointment.select(
        F.col("name").alias("appointment"),
        F.struct("patient", "company", "appointment_date", "authorization_number", "coverage_plan_card_number", "insurance_company").alias("own"),
    )
    coded = t.codification_table.filter((F.col("parenttype") == "Patient Encounter") & F.col("parentfield").isin(*D.BLOCKS))
    diagnosed = coded.select(F.col("parent").alias("encounter"), F.lit(1).alias("disease")).distinct()
    people = t.healthcare_practitioner.select(
        F.col("name").alias("_who"), F.struct(F.col("name").alias("practitioner"), "practitioner_name", "tz_mct_code").alias("person")
    )
    records = t.inpatient_record.select(
        F.col("name").alias("_record"),
        F.struct("scheduled_date", F.to_date("admitted_datetime").alias("admitted_day"), "discharge_date", F.lit(True).alias("recorded")).alias("stay"),
    )
    final = F.coalesce("is_final", F.lit(False))
    encounters = (
        t.patient_encounter.filter(F.col("docstatus") == 1)
        .select(*H.own_visits(), "inpatient_record")
        .join(diagnosed, "encounter", "left")
        .withColumn("_who", spread_null(F.when(final, F.col("practitioner")), "encounter"))
        .join(people, "_who", "left")
        .withColumn("_record", spread_blank(F.when(final, F.col("inpatient_record")), "encounter"))
        .join(records, "_record", "left")
    )
    rows = named.join(appointments, "appointment", "left").join(encounters, "appointment", "left")
    visited = F.col("is_listed") & F.col("encounter").isNotNull()
    stayed = visited & final & (F.col("inpatient_record") != "")
    return _tagged(
        rows,
        own=F.when(F.col("is_own"), F.col("own")),
        visit=visited.cast("int"),
        final=(visited & final).cast("int"),
        disease=F.when(visited, F.col("disease")),
        person=F.when(visited & final, F.col("person")),
        stay_order=F.when(stayed, F.struct("modified", "encounter")),
        stay=F.when(stayed, F.coalesce("stay", F.lit(None).cast(_STAY))),
    )


def _item_part(items: DataFrame) -> DataFrame:
    return _tagged(items.withColumn("claim", F.col("parent")), item=F.lit(1), item_amount=money("amount_claimed"))


def all_facts(claims: DataFrame, items: DataFrame, t: Tables, run: RunContext) -> DataFrame:
    """One row of facts per claim for all rules.

    Claims, their appointments and encounters, and items each give tagged partial rows; one aggregation by claim, with
    partial sums before its exchange, makes them one.
    """
    parts = [_claim_part(claims, t), _care_part(claims, t), _item_part(items)]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    facts = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("claim")
        .agg(
            F.max("row").alias("row"),
            F.max("own").alias("own"),
            total("visit").alias("encounters"),
            total("final").alias("final_encounters"),
            total("disease").alias("disease_rows"),
            F.min("person").alias("first"),
            F.max_by("stay", "stay_order").alias("stay"),
            F.max("stay_order").isNotNull().alias("stayed"),
            total("item").alias("item_rows"),
            F.sum("item_amount").alias("item_total"),
        )
        .filter(F.col("row").isNotNull())
    )
    flat = facts.select(
        "claim",
        "row.*",
        F.col("own").isNotNull().alias("has_appointment"),
        "own.authorization_number",
        "own.coverage_plan_card_number",
        "own.insurance_company",
        F.coalesce(non_blank("row.patient"), "own.patient").alias("header_patient"),
        F.coalesce(non_blank("row.company"), "own.company").alias("_company"),
        F.col("own.appointment_date").alias("attendance_date"),
        H.discharge_day("stay", run).alias("_discharge"),
        *[F.col(c) for c in ("encounters", "final_encounters", "disease_rows", "first", "item_rows", "item_total", "stayed")],
    )
    period = H.with_period(flat.withColumn("date_discharge", F.when(F.col("stayed"), F.col("_discharge"))))
    signatures = t.patient.select(F.col("name").alias("_who"), F.col("patient_signature").alias("_signature"))
    settings = t.company_claim_settings.select(F.col("company").alias("_company"), "submit_claim_month", "submit_claim_year")
    return (
        period.withColumn("_who", spread_blank("header_patient", "claim"))
        .join(signatures, "_who", "left")
        .join(settings, "_company", "left")
        .withColumn("patient_signature", F.coalesce(non_blank("patient_signature"), non_blank("_signature")))
    )


# Rules ---------------------------------------------------------------------------------------------------


def _check(rule: str, broken: Column, detail: Column | None = None) -> Column:
    text = (F.lit(None) if detail is None else detail).cast("string")
    return F.when(broken, F.struct(F.lit(rule).alias("rule"), text.alias("detail")))


def _encounter_rule() -> list[Column]:
    return [_check("no_submitted_encounter", F.col("encounters") == 0)]


def _final_encounter_rule() -> list[Column]:
    return [_check("no_final_encounter", F.col("final_encounters") == 0)]


def _practitioner_rules() -> list[Column]:
    known, who = F.col("first").isNotNull(), F.col("first.practitioner")
    return [
        _check("practitioner_name", known & is_blank("first.practitioner_name"), who),
        _check("practitioner_code", known & is_blank("first.tz_mct_code"), who),
    ]


def _row_rules() -> list[Column]:
    return [_check("no_disease", F.col("disease_rows") == 0), _check("no_item", F.col("item_rows") == 0)]


def _total_rule() -> list[Column]:
    total = F.coalesce(money("total_amount"), F.lit(0))
    return [_check("total_amount", total != F.coalesce("item_total", F.lit(0)))]


def _appointment_rules() -> list[Column]:
    found, name = F.col("has_appointment"), F.col("patient_appointment")
    return [
        _check("authorization_no", found & differs("authorization_no", F.col("authorization_number")), name),
        _check("cardno", found & differs("cardno", F.col("coverage_plan_card_number")), name),
    ]


def _insurer_rule() -> list[Column]:
    insurer = F.col("insurance_company")
    return [_check("other_insurer", insurer.isin(*OTHER_INSURERS), insurer)]


def _draft_rule() -> list[Column]:
    return [
        _check(
            "duplicate_draft", (F.col("docstatus") == 0) & (F.col("drafts") > 1), F.col("patient_appointment")
        )
    ]


def _period_rule() -> list[Column]:
    month, year = F.col("submit_claim_month"), F.col("submit_claim_year")
    unset = (F.coalesce(month, F.lit(0)) == 0) & (F.coalesce(year, F.lit(0)) == 0)
    other = differs("claim_month", month) | differs("claim_year", year)
    period = F.concat_ws("-", F.col("claim_year").cast("string"), F.col("claim_month").cast("string"))
    return [_check("no_submission_period", unset, period), _check("submission_period", ~unset & other, period)]


def _signature_rule() -> list[Column]:
    missing = ~is_blank("header_patient") & is_blank("patient_signature")
    return [_check("patient_signature", missing, F.col("header_patient"))]


def _merge_rules() -> list[Column]:
    appointments, claims = F.col("appointments"), F.col("open_claims")
    return [
        _check("merge_claims", claims > 1, claims),
        _check("merge_appointments", (appointments > 1) & (F.col("merged_here") < appointments), appointments),
    ]


def _report(facts: DataFrame, *rules: list[Column]) -> DataFrame:
    checks = F.array(*[check for rule in rules for check in rule])
    return facts.select("claim", F.explode(F.array_compact(checks)).alias("broken")).select("claim", "broken.*")


def without_encounters(claims: DataFrame, t: Tables) -> DataFrame:
    return _report(_encounter_facts(_rows(claims), claims, t), _encounter_rule())


def without_final_encounters(claims: DataFrame, t: Tables) -> DataFrame:
    return _report(_encounter_facts(_rows(claims), claims, t), _final_encounter_rule())


def practitioner_violations(claims: DataFrame, t: Tables) -> DataFrame:
    """First practitioner without a name, or without a council number."""
    return _report(_encounter_facts(_rows(claims), claims, t), _practitioner_rules())


def without_rows(claims: DataFrame, diseases: DataFrame, items: DataFrame) -> DataFrame:
    """Claims without a disease row, and claims without an item row."""
    return _report(_row_facts(_rows(claims), diseases, items), _row_rules())


def total_violations(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Total amount that is not the sum of the items' amounts, compared exactly."""
    sums = items.groupBy(F.col("parent").alias("claim")).agg(F.sum(money("amount_claimed")).alias("item_total"))
    return _report(_rows(claims).join(sums, "claim", "left"), _total_rule())


def draft_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status") == "Draft").select(
        *violation("parent", "draft_item", F.concat_ws(" ", F.col("idx").cast("string"), "ref_doctype", "item_name"))
    )


def appointment_mismatches(claims: DataFrame, t: Tables) -> DataFrame:
    """Authorization or card number that differs from the appointment's."""
    return _report(_appointment_facts(_rows(claims), t), _appointment_rules())


def other_insurer_claims(claims: DataFrame, t: Tables) -> DataFrame:
    return _report(_appointment_facts(_rows(claims), t), _insurer_rule())


def duplicate_drafts(claims: DataFrame) -> DataFrame:
    """Draft claims that share patient, appointment and card with another draft."""
    return _report(_draft_facts(_rows(claims), claims), _draft_rule())


def submission_period_violations(headers: DataFrame, t: Tables) -> DataFrame:
    """Claims outside their company's submission month, or whose company has none set."""
    return _report(_header_facts(headers, t), _period_rule())


def missing_signatures(headers: DataFrame, t: Tables) -> DataFrame:
    """No signature on the claim nor on its patient."""
    return _report(_header_facts(headers, t), _signature_rule())


def merge_needed(claims: DataFrame, t: Tables) -> DataFrame:
    """Claims that must be merged before they are submitted."""
    return _report(_visit_facts(_rows(claims), claims, t), _merge_rules())


def card_decisions(claims: DataFrame, t: Tables) -> DataFrame:
    """(claim, decision): whether the patient's card can be released."""
    complete = F.col("appointments") - 1 == F.greatest("merged", "open_claims")
    release = (F.col("appointments") <= 1) | complete
    return _visit_facts(_rows(claims), claims, t).select(
        "claim", F.when(release, "Release").otherwise("Hold").alias("decision")
    )


def claim_violations(claims: DataFrame, items: DataFrame, t: Tables, run: RunContext) -> DataFrame:
    """All rules over all claims, from one row of facts per claim."""
    per_claim = _report(
        all_facts(claims, items, t, run),
        _encounter_rule(),
        _final_encounter_rule(),
        _practitioner_rules(),
        _row_rules(),
        _total_rule(),
        _appointment_rules(),
        _insurer_rule(),
        _draft_rule(),
        _period_rule(),
        _signature_rule(),
        _merge_rules(),
    )
    return per_claim.unionByName(draft_items(items))
