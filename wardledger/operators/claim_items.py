"""Line items of a claim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardledger.functions.columns import differs, is_blank, is_set, is_unset, money_sum, non_blank, stable_id, violation
from wardledger.functions.joins import dealt_by, spread_blank, spread_null
from wardledger.operators import claim_header as H
from wardledger.operators.claim_frame import ClaimFrame, chargeable
from wardledger.operators.prescriptions import (
    KINDS, kind_field, lab_tests_under_way, looked_up_in_place, prescriptions, status_of, with_approval, with_item,
)
from wardledger.options import RunContext
from wardledger.sources.schemas import CLAIM_LINE
from wardledger.sources.tables import Tables

LINE_COLUMNS = [f.name for f in CLAIM_LINE.fields]
ORDER_COLUMNS = ["encounter_creation", "table_order", "row_idx"]
# Record types of the lines that are no prescriptions.
APPOINTMENT, OCCUPANCY, CONSULTANCY = "Patient Appointment", "Inpatient Occupancy", "Inpatient Consultancy"
#: The record types in one list, the prescriptions' in their table order.
LINE_TYPES = [*[k.ref_doctype for k in KINDS], APPOINTMENT, OCCUPANCY, CONSULTANCY]
#: What a line is made from, see ``_narrow``; first what lines of an encounter share, which Spark's files then hold shorter.
NARROW_COLUMNS = [
    "claim", "patient_encounter", "item_crt_by", "encounter_creation", "done", "kind", "approval_ref_no", "row_idx", "item_quantity",
    "date_created", "unit_price", "item_code", "item_name", "ref_docname",
]


def _lines(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Claim lines with the columns that break ties in their numbering."""
    named = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    out = []
    for f in CLAIM_LINE.fields:
        out.append(named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    for name, kind in zip(ORDER_COLUMNS, ("timestamp_ntz", "int", "int")):
        out.append(named.get(name, F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def _narrow(lines: DataFrame) -> DataFrame:
    """Lines of quantity times price as they move: without what follows from the other columns (``_from_narrow``)."""
    kind = F.array_position(F.array(*map(F.lit, LINE_TYPES)), F.col("ref_doctype")).cast("int") - 1
    return lines.withColumns({"kind": kind, "done": F.col("status") == "Submitted"}).select(*NARROW_COLUMNS)


def _from_narrow() -> dict[str, Column]:
    """The columns of lines that ``_narrow`` leaves out."""
    return {
        "ref_doctype": F.element_at(F.array(*map(F.lit, LINE_TYPES)), F.col("kind") + 1),
        "table_order": F.when(F.col("kind") < len(KINDS), F.col("kind")),
        "amount_claimed": F.col("unit_price") * F.col("item_quantity"),
        "status": F.when(F.col("done"), "Submitted").when(~F.col("done"), "Draft"),
    }


def with_rate(lines: DataFrame, t: Tables) -> DataFrame:
    """Adds ``rate`` by item, company, subscription and insurer; NULL where there is none.

    A key that is stored twice gives its lowest rate, never a second line.
    """
    subscription = F.col("insurance_subscription").alias("_subscription")
    rates = t.item_rate.groupBy("item_code", "company", subscription, "insurance_company").agg(
        F.min("rate").alias("rate")
    )
    return (
        lines.withColumn("_subscription", spread_null("insurance_subscription", "ref_docname"))
        .join(rates, ["item_code", "company", "_subscription", "insurance_company"], "left")
        .drop("_subscription")
    )


def _prescribed_lines(encounters: DataFrame, t: Tables) -> DataFrame:
    """Lines of the prescriptions of these (claim, encounter, inpatient) rows."""
    return _care_lines(with_item(with_approval(_with_done(_care(encounters, t), t), t), t))


def _care(encounters: DataFrame, t: Tables) -> DataFrame:
    """The prescriptions of these (claim, encounter, inpatient) rows, by encounter.

    Inpatient lines are named by the template's code, others by its display name. A row carries only what its line needs,
    its kind as a number (``kind_field``).
    """
    delivered = F.coalesce("quantity", F.lit(0.0)) - F.coalesce("quantity_returned", F.lit(0.0))
    rows = prescriptions(t).filter(is_unset("prescribe") & is_unset("is_cancelled")).select(
        "parent", "table_order", "idx", F.when(delivered == 0, F.lit(1.0)).otherwise(delivered).alias("item_quantity"),
        F.to_date("modified").alias("date_created"), "amount", "template", "display_name", "name", "document",
    )
    visits = encounters.select(
        "claim", F.col("encounter").alias("parent"), F.col("creation").alias("encounter_creation"), "practitioner", "inpatient"
    )
    return rows.join(visits, "parent").select(
        "claim", "parent", "name", "template", "document", "amount", "item_quantity", "date_created", "practitioner",
        "encounter_creation", "table_order", "idx",
        F.when(F.col("inpatient"), F.col("template")).otherwise(F.col("display_name")).alias("item_name"),
    )


def _with_done(care: DataFrame, t: Tables) -> DataFrame:
    """Adds whether the service was done, from the lab tests of its encounter, where the rows lie."""
    found = care.join(lab_tests_under_way(t), "parent", "left")
    return found.withColumn("done", status_of() == "Submitted").drop("under_way")


def _care_lines(found: DataFrame) -> DataFrame:
    return _lines(
        found,
        claim="claim",
        item_name="item_name",
        item_code="item_code",
        item_quantity="item_quantity",
        unit_price="amount",
        amount_claimed=F.col("amount") * F.col("item_quantity"),
        approval_ref_no="approval_ref_no",
        status=F.when(F.col("done"), "Submitted").otherwise("Draft"),
        patient_encounter="parent",
        ref_doctype=kind_field("ref_doctype"),
        ref_docname="name",
        date_created="date_created",
        item_crt_by="practitioner",
        encounter_creation="encounter_creation",
        table_order="table_order",
        row_idx="idx",
    )


def inpatient_claims(claims: DataFrame, records: DataFrame, t: Tables) -> DataFrame:
    """(claim, inpatient_record, admission_encounter, ...) of claims with an inpatient record."""
    admissions = t.inpatient_record.select(F.col("name").alias("inpatient_record"), "admission_encounter")
    heads = claims.select(F.col("name").alias("claim"), "patient_appointment", "company")
    return records.join(admissions, "inpatient_record", "left").join(heads, "claim")


def stay_days(t: Tables) -> DataFrame:
    """(inpatient_record, day, service_unit, position): the first occupancy of each check-in day, confirmed or not."""
    return (
        t.inpatient_occupancy.groupBy(
            F.col("parent").alias("inpatient_record"), F.to_date("check_in").alias("day")
        )
        .agg(F.min(F.struct("idx", "name", "service_unit")).alias("first"))
        .select("inpatient_record", "day", "first.service_unit", F.col("first.idx").alias("position"))
    )


def claimed_encounters(claims: DataFrame, records: DataFrame, t: Tables) -> DataFrame:
    """Encounters whose prescriptions a claim bills, each claim's encounters read once.

    All of an outpatient claim; of an inpatient claim those on a check-in day, with the position of
    that day's first bed. Those of other days are not claimed.
    """
    days = stay_days(t).select(F.col("inpatient_record").alias("_record"), F.col("day").alias("encounter_date"), "position")
    inpatient = F.col("inpatient_record").isNotNull()
    return (
        H.submitted_encounters(claims, t)
        .join(records.select("claim", "inpatient_record"), "claim", "left")
        .withColumn("_record", spread_null("inpatient_record", "encounter"))
        .join(days, ["_record", "encounter_date"], "left")
        .filter(~inpatient | F.col("position").isNotNull())
        .select(
            "claim",
            "encounter",
            "creation",
            "practitioner",
            inpatient.alias("inpatient"),
            F.coalesce("position", F.lit(0)).alias("position"),
        )
    )


def outpatient_lines(claims: DataFrame, records: DataFrame, t: Tables) -> DataFrame:
    """Service lines of claims without an inpatient record."""
    return _prescribed_lines(claimed_encounters(claims, records, t).filter(~F.col("inpatient")), t)


def admission_lines(stays: DataFrame, t: Tables) -> DataFrame:
    """One line per inpatient claim for its own appointment."""
    appointments = t.patient_appointment.select(
        F.col("name").alias("patient_appointment"), "billing_item", "paid_amount", "creation", "practitioner"
    )
    return _admission_lines(stays.join(appointments, "patient_appointment"))


def _admission_lines(rows: DataFrame) -> DataFrame:
    return _lines(
        rows,
        claim="claim",
        item_name="billing_item",
        item_code="billing_item",
        item_quantity=F.lit(1.0),
        unit_price="paid_amount",
        amount_claimed="paid_amount",
        approval_ref_no=F.lit(""),
        patient_encounter="admission_encounter",
        ref_doctype=F.lit(APPOINTMENT),
        ref_docname="patient_appointment",
        date_created=F.to_date("creation"),
        item_crt_by="practitioner",
    )


def _unit_types(t: Tables) -> DataFrame:
    types = t.healthcare_service_unit_type.select(
        F.col("name").alias("service_unit_type"), F.col("item").alias("item_code"), "is_consultancy_chargeable"
    )
    units = t.healthcare_service_unit.select(F.col("name").alias("service_unit"), "service_unit_type")
    return units.join(types, "service_unit_type").drop("service_unit_type")


def _insured_occupancies(stays: DataFrame, t: Tables) -> DataFrame:
    """Confirmed occupancies with the item of their unit type and the admission's insurance."""
    occupancies = t.inpatient_occupancy.filter(is_set("is_confirmed")).select(
        F.col("parent").alias("inpatient_record"),
        F.col("name").alias("ref_docname"),
        "service_unit",
        "modified",
        "modified_by",
        "idx",
    )
    insurance = t.patient_encounter.select(
        F.col("name").alias("_admission"), "insurance_subscription", "insurance_company"
    )
    insured = stays.withColumn("_admission", spread_blank("admission_encounter", "claim")).join(insurance, "_admission", "left")
    return occupancies.join(insured.drop("_admission"), "inpatient_record").join(_unit_types(t), "service_unit", "left")


def bed_lines(stays: DataFrame, t: Tables) -> DataFrame:
    """One line per confirmed bed occupancy."""
    return _rated_lines(with_rate(_bed_rows(_insured_occupancies(stays, t)), t))


RATED_COLUMNS = [
    "claim", "item_name", "item_code", "patient_encounter", "ref_doctype", "ref_docname", "date_created", "item_crt_by", "row_idx",
]
RATE_KEYS = ["company", "insurance_subscription", "insurance_company"]


def _bed_rows(occupancies: DataFrame) -> DataFrame:
    """Occupancies in the columns of lines whose price is a rate."""
    return occupancies.withColumns(
        {
            "item_name": F.col("service_unit"),
            "patient_encounter": F.col("admission_encounter"),
            "ref_doctype": F.lit(OCCUPANCY),
            "date_created": F.to_date("modified"),
            "item_crt_by": F.col("modified_by"),
            "row_idx": F.col("idx"),
        }
    )


def _consultation_rows(appointments: DataFrame) -> DataFrame:
    """A claim's chargeable appointments in the columns of lines whose price is a rate."""
    return appointments.withColumns(
        {
            "item_name": F.col("item_code"),
            "patient_encounter": F.lit(None).cast("string"),
            "ref_doctype": F.lit(APPOINTMENT),
            "date_created": F.to_date("modified"),
            "item_crt_by": F.col("practitioner"),
            "row_idx": F.col("position"),
        }
    )


def _rated_lines(rows: DataFrame) -> DataFrame:
    """Lines of quantity 1 at their ``rate``."""
    return _lines(
        rows,
        **{c: c for c in RATED_COLUMNS},
        item_quantity=F.lit(1.0),
        unit_price="rate",
        amount_claimed="rate",
        approval_ref_no=F.lit(""),
    )


def inpatient_consultancy_lines(stays: DataFrame, t: Tables) -> DataFrame:
    """Confirmed, priced consultancies on days whose first bed allows charging them."""
    chargeable = (
        stay_days(t)
        .join(_unit_types(t), "service_unit")
        .filter(is_set("is_consultancy_chargeable"))
        .select("inpatient_record", "day")
    )
    rows = _consultancies(t).join(chargeable, ["inpatient_record", "day"]).join(stays, "inpatient_record")
    return _consultancy_lines(rows)


def _consultancies(t: Tables) -> DataFrame:
    """Confirmed, priced consultancies of inpatient records."""
    return t.inpatient_consultancy.filter(is_set("is_confirmed") & (F.col("rate") != 0)).select(
        F.col("parent").alias("inpatient_record"),
        F.col("date").alias("day"),
        F.col("name").alias("ref_docname"),
        "consultation_item",
        "rate",
        "encounter",
        "modified",
        "healthcare_practitioner",
        "idx",
    )


def _consultancy_lines(rows: DataFrame) -> DataFrame:
    return _lines(
        rows,
        claim="claim",
        item_name="consultation_item",
        item_code="consultation_item",
        item_quantity=F.lit(1.0),
        unit_price="rate",
        amount_claimed="rate",
        approval_ref_no=F.lit(""),
        patient_encounter=F.coalesce(non_blank("encounter"), "admission_encounter"),
        ref_doctype=F.lit(CONSULTANCY),
        ref_docname="ref_docname",
        date_created=F.to_date("modified"),
        item_crt_by="healthcare_practitioner",
        row_idx="idx",
    )


def _stay_lines(stays: DataFrame, t: Tables) -> DataFrame:
    parts = [admission_lines(stays, t), bed_lines(stays, t), inpatient_consultancy_lines(stays, t)]
    return reduce(DataFrame.unionByName, parts)


def inpatient_lines(claims: DataFrame, records: DataFrame, t: Tables) -> DataFrame:
    """All service lines of claims with an inpatient record."""
    visits = claimed_encounters(claims, records, t).filter("inpatient")
    return _stay_lines(inpatient_claims(claims, records, t), t).unionByName(_prescribed_lines(visits, t))


def _priced_appointments(claims: DataFrame, records: DataFrame, t: Tables) -> DataFrame:
    appointments = t.patient_appointment.filter(chargeable()).select(
        F.col("name").alias("ref_docname"),
        F.col("billing_item").alias("item_code"),
        "insurance_subscription",
        "insurance_company",
        "modified",
        "practitioner",
    )
    heads = claims.select(F.col("name").alias("claim"), "company")
    rows = (
        H.claim_appointments(claims)
        .join(records.select("claim"), "claim", "left_anti")
        .withColumnRenamed("appointment", "ref_docname")
        .join(heads, "claim")
        .join(appointments, "ref_docname")
    )
    return with_rate(rows, t)


def consultation_lines(claims: DataFrame, records: DataFrame, t: Tables) -> DataFrame:
    """One line per chargeable appointment of claims without an inpatient record."""
    return _rated_lines(_consultation_rows(_priced_appointments(claims, records, t)))


def price_violations(lines: DataFrame) -> DataFrame:
    """Lines for which no rate was found."""
    return lines.filter(F.col("unit_price").isNull()).select(
        *violation("claim", "item_rate", F.concat_ws(" ", "ref_doctype", "ref_docname", "item_code"))
    )


def numbered_lines(
    claims: DataFrame, services: DataFrame, consultations: DataFrame, derived: dict[str, Column] | None = None
) -> DataFrame:
    """Lines with ``idx``: consultations from 1, services after the claim's appointment count.

    ``derived`` are columns that the services lack and that are computed where their claim lies.

    Lines lie by claim (``dealt_by``) and are numbered there: the claim's count is sorted in before its services and
    weighs what they go on from, so nothing is joined, and a window holds none of the rows in memory.
    """
    counts = claims.select(F.col("name").alias("claim"), F.size(H.listed_appointments()).cast("long").alias("_weight"), F.lit(0).alias("_given"))
    order = [
        F.col(c).asc_nulls_first()
        for c in (
            "ref_doctype", "item_code", "date_created", "encounter_creation", "patient_encounter",
            "table_order", "row_idx", "ref_docname",
        )
    ]
    rows = services.withColumns({"_weight": F.lit(1).cast("long"), "_given": F.lit(1)}).unionByName(counts, allowMissingColumns=True)
    in_claim = Window.partitionBy("claim").orderBy("_given", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = dealt_by(rows, "claim").withColumns(derived or {}).withColumn("idx", F.sum("_weight").over(in_claim).cast("int")).filter("_given = 1")
    by_position = Window.partitionBy("claim").orderBy("row_idx")
    first = consultations.withColumn("idx", F.row_number().over(by_position))
    columns = ["idx", *LINE_COLUMNS]
    return numbered.select(*columns).unionByName(first.select(*columns))


def claim_lines(claims: DataFrame, t: Tables) -> DataFrame:
    """All numbered lines of each claim."""
    frame = ClaimFrame(claims, t, keep=("claims", "appointments", "visits", "stays"), lines_only=True)
    frame.prepare()
    return claim_lines_of(frame)


def claim_lines_of(frame: ClaimFrame) -> DataFrame:
    """All numbered lines of each claim, from its kept appointments, visits and stay.

    Beds and consultations are united before their rates are looked up; their record type tells them apart again. The
    prescriptions and the other lines are written in steps of their own, so that the disk holds what one step shuffles.
    """
    stays, t = frame.stays, frame.t
    care = frame.space.keep(_care(frame.with_people(frame.billed), t), "care", by=("parent",))
    own = frame.appointments.filter("position = -1").select("claim", "billing_item", "paid_amount", "creation", "practitioner")
    beds = _insured_occupancies(stays, t)
    visits = (
        _consultancies(t)
        .join(stays, "inpatient_record")
        .withColumn("service_unit", F.try_element_at("days", F.col("day"))["service_unit"])
        .join(_unit_types(t), "service_unit")
        .filter(is_set("is_consultancy_chargeable"))
    )
    consultations = (
        frame.appointments.filter("position >= 0")
        .join(stays.select("claim"), "claim", "left_anti")
        .drop("company")
        .withColumnsRenamed({"claim_company": "company", "appointment": "ref_docname", "billing_item": "item_code"})
    )
    columns = [*RATED_COLUMNS, *RATE_KEYS]
    tagged = _bed_rows(beds).select(*columns).unionByName(_consultation_rows(consultations).select(*columns))
    rated = _narrow(_rated_lines(with_rate(tagged, t))).withColumn("consultation", F.col("kind") == LINE_TYPES.index(APPOINTMENT))
    unrated = _narrow(_admission_lines(stays.join(own, "claim"))).unionByName(_narrow(_consultancy_lines(visits)))
    others = frame.space.keep(rated.unionByName(unrated.withColumn("consultation", F.lit(False))), "others")
    prescribed = _narrow(_care_lines(looked_up_in_place(_with_done(care, t), t)))
    services = others.filter("not consultation").drop("consultation").unionByName(prescribed)
    return numbered_lines(frame.claims, services, others.filter("consultation").withColumns(_from_narrow()), _from_narrow())


def completed_items(items: DataFrame, headers: DataFrame, run: RunContext) -> DataFrame:
    """Items as saved: amount recomputed, missing date and ids filled."""
    folios = headers.select(F.col("name").alias("parent"), F.col("folio_id").alias("_folio"))
    own_id = stable_id("parent", "ref_doctype", "ref_docname", F.col("idx").cast("string"))
    return (
        items.join(folios, "parent", "left")
        .withColumn("amount_claimed", F.col("unit_price") * F.col("item_quantity"))
        .withColumn("folio_item_id", F.coalesce(non_blank("folio_item_id"), own_id))
        .withColumn("date_created", F.coalesce("date_created", run.today))
        .withColumn("folio_id", F.coalesce(non_blank("folio_id"), "_folio"))
        .select(*items.columns)
    )


def completed_diseases(diseases: DataFrame, headers: DataFrame, run: RunContext) -> DataFrame:
    """Diseases as saved, with folio id, own id and date."""
    folios = headers.select(F.col("name").alias("claim"), "folio_id")
    return (
        diseases.join(folios, "claim", "left")
        .withColumn("folio_disease_id", stable_id("claim", "status", "codification_table"))
        .withColumn("date_created", F.coalesce("date_created", run.today))
    )


def claim_totals(items: DataFrame) -> DataFrame:
    """(claim, total_amount) from recomputed amounts."""
    amount = F.col("unit_price") * F.col("item_quantity")
    return items.groupBy(F.col("parent").alias("claim")).agg(money_sum(amount).alias("total_amount"))


def item_reference_codes(t: Tables) -> DataFrame:
    """Each item's code at its other insurers; the smallest where there are several."""
    codes = (
        t.item_customer_detail.filter(differs("customer_name", "NHIF"))
        .groupBy(F.col("parent").alias("item_code"))
        .agg(F.min("ref_code").alias("ref_code"))
    )
    return t.item.select("item_code").join(codes, "item_code", "left")


def reference_code_violations(t: Tables) -> DataFrame:
    return (
        item_reference_codes(t)
        .filter(is_blank("ref_code"))
        .select("item_code", F.lit("item_reference_code").alias("rule"))
    )
