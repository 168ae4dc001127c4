"""Claim header: the claim's appointments, encounters, practitioners, stay, period and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import clock, is_blank, joined, non_blank, violation
from wardledger.functions.joins import spread_blank
from wardledger.functions.numbering import number_within
from wardledger.options import RunContext
from wardledger.sources.schemas import CLAIM_HEADER, shaped
from wardledger.sources.tables import Tables


def listed_appointments() -> Column:
    """The claim's JSON list, or its single appointment."""
    listed = F.from_json("claim_appointment_list", "array<string>")
    return F.when(F.size(listed) > 0, listed).otherwise(F.array("patient_appointment"))


def claim_appointments(claims: DataFrame) -> DataFrame:
    """(claim, position, appointment) of each claim's appointments."""
    return claims.select(
        F.col("name").alias("claim"), F.posexplode(listed_appointments()).alias("position", "appointment")
    )


def _appointment_set(claims: DataFrame) -> DataFrame:
    """The distinct appointments of each claim, for membership joins."""
    appointments = F.array_distinct(listed_appointments())
    found = claims.select(F.col("name").alias("claim"), F.explode(appointments).alias("appointment"))
    return found.filter(~is_blank("appointment"))  # blank ones would meet all blank ones


def _is_final() -> Column:
    return (F.col("duplicated") == 0) & (F.col("encounter_type") == "Final")


def own_visits() -> list[Column]:
    """What a claim reads of each encounter."""
    names = ["appointment", "encounter_date", "creation", "modified", "practitioner"]
    return [F.col("name").alias("encounter"), *map(F.col, names), _is_final().alias("is_final")]


def submitted_encounters(claims: DataFrame, t: Tables) -> DataFrame:
    """(claim, encounter, ...) of the claim's appointments, without the order number."""
    encounters = t.patient_encounter.filter(F.col("docstatus") == 1).select(*own_visits())
    return _appointment_set(claims).join(encounters, "appointment").drop("appointment")


def claim_encounters(claims: DataFrame, t: Tables) -> DataFrame:
    """Submitted encounters of each claim, numbered by creation."""
    found = submitted_encounters(claims, t).select("claim", "encounter", "encounter_date", "creation")
    return number_within(found, ["claim"], [F.col("creation").asc(), F.col("encounter").asc()], "sequence")


def final_encounters(claims: DataFrame, t: Tables) -> DataFrame:
    """Submitted, not duplicated encounters of type ``Final``, without the order number."""
    finals = t.patient_encounter.filter((F.col("docstatus") == 1) & _is_final()).select("appointment", F.col("name").alias("encounter"), "practitioner", "inpatient_record", "modified")
    return _appointment_set(claims).join(finals, "appointment").drop("appointment")


def final_encounters_ranked(claims: DataFrame, t: Tables) -> DataFrame:
    """Final encounters of each claim, the latest modified first."""
    order = [F.col("modified").desc(), F.col("encounter").desc()]
    return number_within(final_encounters(claims, t), ["claim"], order, "sequence")


def claim_practitioners(finals: DataFrame, t: Tables) -> DataFrame:
    """First practitioner's name and all council numbers per claim, in order of practitioner id."""
    distinct = finals.select("claim", F.col("practitioner").alias("id")).distinct()
    details = t.healthcare_practitioner.select(F.col("name").alias("id"), "practitioner_name", "tz_mct_code")
    return people_of_claims(distinct.join(details, "id"))


def people_of_claims(rows: DataFrame) -> DataFrame:
    """As ``claim_practitioners``, from (claim, id, practitioner_name, tz_mct_code) rows."""
    ordered = F.array_sort(F.collect_set(F.struct("id", "practitioner_name", "tz_mct_code")))
    return (
        rows.groupBy("claim")
        .agg(ordered.alias("people"))
        .select(
            "claim",
            F.col("people")[0]["id"].alias("first_practitioner"),
            F.col("people")[0]["practitioner_name"].alias("practitioner_name"),
            F.col("people")[0]["tz_mct_code"].alias("first_code"),
            F.array_join(F.transform("people", lambda p: p["tz_mct_code"]), ",").alias("practitioner_no"),
        )
    )


def claim_inpatient_record(finals: DataFrame) -> DataFrame:
    """(claim, inpatient_record) for claims with a non-empty record on a final encounter."""
    return (
        finals.filter(F.col("inpatient_record") != "")
        .groupBy("claim")
        .agg(F.max_by("inpatient_record", F.struct("modified", "encounter")).alias("inpatient_record"))
    )


def claim_stay(records: DataFrame, t: Tables, run: RunContext) -> DataFrame:
    """Admission and discharge of the claims with an inpatient record.

    Same-day discharges are outpatients. A missing date counts as today in the comparisons, as in
    the reports this replaces.
    """
    details = t.inpatient_record.select(
        F.col("name").alias("inpatient_record"),
        F.lit(True).alias("recorded"),
        "discharge_date",
        "scheduled_date",
        F.to_date("admitted_datetime").alias("admitted_day"),
        clock("creation").alias("created_clock"),
        clock("admitted_datetime").alias("admitted_clock"),
    )
    return stay_columns(records.join(details, "inpatient_record", "left"), run)


def _admission(stay: str, run: RunContext) -> tuple[Column, Column]:
    """Whether the scheduled date comes first, and the day of admission; a missing date is today where it is compared."""
    scheduled, admitted = F.col(f"{stay}scheduled_date"), F.col(f"{stay}admitted_day")
    scheduled_first = F.coalesce(scheduled, run.today) < F.coalesce(admitted, run.today)
    return scheduled_first, F.when(F.col(f"{stay}recorded"), F.when(scheduled_first, scheduled).otherwise(admitted))


def discharge_day(stay: str, run: RunContext) -> Column:
    """The discharge of a stay (a struct column), NULL where it was the day of admission."""
    admitted_on, discharged = _admission(f"{stay}.", run)[1], F.col(f"{stay}.discharge_date")
    return F.when(F.coalesce(admitted_on, run.today) != F.coalesce(discharged, run.today), discharged)


def stay_columns(stays: DataFrame, run: RunContext) -> DataFrame:
    """As ``claim_stay``, from claims joined with their records; ``recorded`` where the record exists."""
    today = run.today
    scheduled_first, admitted_on = _admission("", run)
    admitted_time = F.when(scheduled_first, F.col("created_clock")).otherwise(F.col("admitted_clock"))
    with_admission = stays.withColumns(
        {"admitted_on": admitted_on, "admitted_time": F.when(F.col("recorded"), admitted_time)}
    )
    same_day = F.coalesce("admitted_on", today) == F.coalesce("discharge_date", today)
    return with_admission.select(
        "claim",
        "inpatient_record",
        F.when(same_day, "OUT").otherwise("IN").alias("patient_type_code"),
        F.when(~same_day, F.col("admitted_on")).alias("date_admitted"),
        "admitted_time",
        F.when(~same_day, F.col("discharge_date")).alias("date_discharge"),
        F.when(~same_day, run.time_text).alias("discharge_time"),
    )


def claim_stays(claims: DataFrame, t: Tables, run: RunContext) -> DataFrame:
    """One row per claim; ``OUT`` and empty where there is no inpatient record."""
    stays = claim_stay(claim_inpatient_record(final_encounters(claims, t)), t, run)
    return (
        claims.select(F.col("name").alias("claim"))
        .join(stays, "claim", "left")
        .withColumn("patient_type_code", F.coalesce("patient_type_code", F.lit("OUT")))
    )


def with_period(df: DataFrame) -> DataFrame:
    """Claim year and month: of the discharge, else of the attendance."""
    day = F.coalesce("date_discharge", "attendance_date")
    return df.withColumn("claim_year", F.year(day)).withColumn("claim_month", F.month(day))


def claim_headers(claims: DataFrame, t: Tables, run: RunContext) -> DataFrame:
    """Claims with everything the header takes from other tables."""
    finals = final_encounters(claims, t)
    stays = claim_stay(claim_inpatient_record(finals), t, run)
    return finished_headers(_known_headers(_with_own_appointment(claims, t), claim_practitioners(finals, t), stays, t), run)


def known_headers_of(frame, run: RunContext) -> DataFrame:
    """What ``finished_headers`` makes the headers of, from the kept tables of a ``ClaimFrame``."""
    people = frame.with_people(frame.finals).filter("known").select("claim", F.col("practitioner").alias("id"), "practitioner_name", "tz_mct_code")
    return _known_headers(_with_kept_appointment(frame), people_of_claims(people), stay_columns(frame.stays, run), frame.t)


def claim_patients_of(frame) -> DataFrame:
    """(name, patient_name, gender, date_of_birth) of each claim's patient."""
    claims = _with_kept_appointment(frame).select("name", F.coalesce(non_blank("patient"), "_patient").alias("patient"))
    return _with_patient(claims, frame.t).select("name", "patient_name", "gender", "date_of_birth")


def claim_periods(claims: DataFrame, t: Tables, run: RunContext) -> DataFrame:
    """(name, patient_appointment, company, creation, claim_year, claim_month): the header's part that numbers and changes need."""
    stays = claim_stay(claim_inpatient_record(final_encounters(claims, t)), t, run).select(F.col("claim").alias("name"), "date_discharge")
    own = _with_own_appointment(claims.select("name", "patient_appointment", "company", "creation"), t)
    period = own.join(stays, "name", "left").withColumns({"company": F.coalesce(non_blank("company"), "_company"), "attendance_date": F.col("_date")})
    return with_period(period).select("name", "patient_appointment", "company", "creation", "claim_year", "claim_month")


def _with_own_appointment(claims: DataFrame, t: Tables) -> DataFrame:
    """Claims with the columns of their own appointment."""
    appointments = t.patient_appointment.select(F.col("name").alias("_own"), *_own_appointment())
    return claims.withColumn("_own", spread_blank("patient_appointment", "name")).join(appointments, "_own", "left").drop("_own")


def _with_kept_appointment(frame) -> DataFrame:
    own = frame.appointments.filter("position = -1").select(F.col("claim").alias("name"), *_own_appointment())
    return frame.claims.join(own, "name", "left")


def _own_appointment() -> list[Column]:
    return [
        F.col("patient").alias("_patient"),
        F.col("company").alias("_company"),
        F.col("coverage_plan_card_number").alias("_card"),
        F.col("authorization_number").alias("_authorization"),
        F.col("coverage_plan_name").alias("_plan"),
        F.col("appointment_date").alias("_date"),
        F.col("appointment_time").alias("_time"),
    ]


def _with_patient(claims: DataFrame, t: Tables) -> DataFrame:
    patients = t.patient.select(
        F.col("name").alias("_who"),
        "patient_name",
        "first_name",
        "last_name",
        F.col("mobile").alias("telephone_no"),
        F.col("dob").alias("date_of_birth"),
        F.col("sex").alias("gender"),
        F.col("patient_signature").alias("_signature"),
    )
    return claims.withColumn("_who", spread_blank("patient", "name")).join(patients, "_who", "left").drop("_who")


#: What a header shows and nothing stores: ``finished_headers`` computes it.
_COMPUTED = ["posting_date", "claim_year", "claim_month", "serial_no", "item_crt_by", "patient_file_no"]


def _known_headers(claims: DataFrame, people: DataFrame, stays: DataFrame, t: Tables) -> DataFrame:
    """Claims with their own appointment, practitioners, stay and patient: the columns of a header that are not computed."""
    settings = t.company_claim_settings.select("company", "facility_code")
    known = (
        claims.drop("attendance_date", "authorization_no", "practitioner_name", "practitioner_no")
        .join(people.select(F.col("claim").alias("name"), "practitioner_name", "practitioner_no"), "name", "left")
        .join(stays.withColumnRenamed("claim", "name"), "name", "left")
        .withColumn("patient", F.coalesce(non_blank("patient"), "_patient"))
        .withColumn("company", F.coalesce(non_blank("company"), "_company"))
        .withColumn("cardno", F.coalesce(non_blank("cardno"), "_card"))
        .withColumn("coverage_plan_name", F.coalesce(non_blank("coverage_plan_name"), "_plan"))
        .withColumnsRenamed(
            {"_authorization": "authorization_no", "_date": "attendance_date", "_time": "attendance_time"}
        )
    )
    header = (
        _with_patient(known, t)
        .join(settings, "company", "left")
        .withColumn("patient_type_code", F.coalesce("patient_type_code", F.lit("OUT")))
        .withColumn("patient_signature", F.coalesce(non_blank("patient_signature"), non_blank("_signature")))
    )
    return header.select(*[f.name for f in CLAIM_HEADER.fields if f.name not in _COMPUTED])


def finished_headers(known: DataFrame, run: RunContext) -> DataFrame:
    """Headers: ids, numbers and dates that follow from the claim are added to what is known of it."""
    header = (
        known.withColumn("patient_file_no", F.col("patient"))
        .withColumn("serial_no", F.substring("name", -9, 9).try_cast("int"))
        .withColumn("posting_date", run.today)
        .withColumn("folio_id", F.coalesce(non_blank("folio_id"), F.sha2(F.concat_ws("|", F.lit("folio"), "name"), 256)))
        .withColumn("item_crt_by", F.lit(run.user_name))
    )
    return shaped(with_period(header), CLAIM_HEADER)


FOLIO_KEYS = ["company", "claim_year", "claim_month"]


def folio_numbers(headers: DataFrame, counters: DataFrame, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(claims with folio_no, new counters) per company and claim month, after the stored counters.

    A company's month may hold any share of the claims, so it is numbered in slices. ``stored`` headers are read from
    a written table.
    """
    last = counters.groupBy(*FOLIO_KEYS).agg(F.max("folio_no").alias("last_no"))
    claims = number_within(
        headers.select(F.col("name").alias("claim"), *FOLIO_KEYS, "creation"),
        FOLIO_KEYS,
        [F.col("creation").asc(), F.col("claim").asc()],
        "folio_no",
        after=last,
        stored=stored,
    ).drop("creation")
    return claims, folio_counters(headers, counters)


def folio_counters(headers: DataFrame, counters: DataFrame) -> DataFrame:
    """The counters after the claims were numbered: the last number and the claims since, without numbering them."""
    stored = counters.groupBy(*FOLIO_KEYS).agg(F.max("folio_no").alias("folio_no"))
    added = headers.groupBy(*FOLIO_KEYS).agg(F.count(F.lit(1)).cast("int").alias("folio_no"))
    return stored.unionByName(added).groupBy(*FOLIO_KEYS).agg(F.sum("folio_no").cast("int").alias("folio_no"))


def eligible_appointments(t: Tables) -> DataFrame:
    """Appointments a claim can be made for: insured elsewhere and not claimed yet."""
    return t.patient_appointment.filter(
        (is_blank("nhif_patient_claim") | (F.col("nhif_patient_claim") == "None"))
        & (F.col("insurance_company").isNull() | ~F.col("insurance_company").contains("NHIF"))
        & ~is_blank("insurance_subscription")
        & (F.col("insurance_subscription") != "None")
    )


def link_appointments(appointments: DataFrame, claims: DataFrame) -> DataFrame:
    """New appointment table: links to these claims are renewed from the claims' appointments.

    An appointment named by several claims goes to the latest of them.
    """
    links = (
        claim_appointments(claims)
        .join(claims.select(F.col("name").alias("claim"), "creation"), "claim")
        .groupBy("appointment")
        .agg(F.max_by("claim", F.struct("creation", "claim")).alias("_new"))
        .withColumnRenamed("appointment", "name")
    )
    known = claims.select(F.col("name").alias("_old"), F.lit(True).alias("_stale"))
    return (
        appointments.withColumn("_old", spread_blank("nhif_patient_claim", "name"))
        .join(known, "_old", "left")
        .join(links, "name", "left")
        .withColumn(
            "nhif_patient_claim",
            F.coalesce("_new", F.when(F.col("_stale"), F.lit("")).otherwise(F.col("nhif_patient_claim"))),
        )
        .select(*appointments.columns)
    )


def unlink_deleted_claims(appointments: DataFrame, deleted: DataFrame) -> DataFrame:
    """New appointment table after claims were deleted: only their own appointment's link goes."""
    gone = deleted.select(
        F.col("patient_appointment").alias("name"),
        F.col("name").alias("nhif_patient_claim"),
        F.lit(True).alias("_gone"),
    ).distinct()
    return (
        appointments.join(gone, ["name", "nhif_patient_claim"], "left")
        .withColumn("nhif_patient_claim", F.when(F.col("_gone"), F.lit("")).otherwise(F.col("nhif_patient_claim")))
        .select(*appointments.columns)
    )


def claims_with_returns(claims: DataFrame, t: Tables) -> DataFrame:
    """Claims whose patient and appointment have submitted return documents, with their names."""
    returns = t.lrpmt_returns.filter(F.col("docstatus") == 1).select(
        "patient", F.col("appointment").alias("patient_appointment"), F.struct("name").alias("document")
    )
    wanted = claims.filter(~is_blank("patient") & ~is_blank("patient_appointment"))
    return (
        wanted.select(F.col("name").alias("claim"), "patient", "patient_appointment")
        .join(returns, ["patient", "patient_appointment"])
        .groupBy("claim")
        .agg(joined(F.collect_list("document"), "name").alias("return_documents"))
    )


def header_violations(claims: DataFrame, t: Tables) -> DataFrame:
    """Practitioner codes that had to be left out of ``practitioner_no``."""
    finals = final_encounters(claims, t).select("claim", F.col("practitioner").alias("id")).distinct()
    missing = t.healthcare_practitioner.filter(is_blank("tz_mct_code")).select(F.col("name").alias("id"))
    return finals.join(missing, "id").select(*violation("claim", "practitioner_code", F.col("id")))
