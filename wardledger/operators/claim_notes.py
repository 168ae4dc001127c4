"""Clinical notes of a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import is_blank, joined
from wardledger.operators import claim_header as H
from wardledger.operators.claim_frame import ClaimFrame
from wardledger.operators.claim_items import claimed_encounters
from wardledger.options import RunContext
from wardledger.sources.tables import Tables


def _text(value: str) -> Column:
    """Missing values print as ``None``."""
    return F.coalesce(F.col(value).cast("string"), F.lit("None"))


def note_encounters(claims: DataFrame, t: Tables) -> DataFrame:
    """(claim, encounter, place): the encounters whose notes a claim shows, and their order.

    Inpatient claims show only those on a check-in day, day by day.
    """
    records = H.claim_inpatient_record(H.final_encounters(claims, t))
    return claimed_encounters(claims, records, t).select(
        "claim", "encounter", F.struct("position", "creation", "encounter").alias("place")
    )


def _drug_text(billed: DataFrame, t: Tables) -> DataFrame:
    """All drug rows of each billed encounter as text, in row order."""
    # The given texts of a note.
    def part(label: str, column: str) -> Column:
        return F.when(~is_blank(column), F.concat(F.lit(f", {label}: "), F.col(column))).otherwise("")

    line = F.concat(
        F.lit("Drug: "), _text("drug_code"), F.lit(" "),
        part("Dosage", "dosage"), part("Period", "period"), part("Dosage Form", "dosage_form"),
        F.lit("<br>"),
    )
    return (
        t.drug_prescription.select(F.col("parent").alias("encounter"), F.struct("idx", "name", line.alias("line")).alias("row"))
        .join(billed.select("encounter"), "encounter", "left_semi")
        .groupBy("encounter")
        .agg(F.concat(F.lit("<br>Medication(s): <br>"), joined(F.collect_list("row"), "line", "")).alias("drugs"))
    )


def _encounter_notes(billed: DataFrame, t: Tables) -> DataFrame:
    """(claim, place, note) of each billed encounter."""
    visits = t.patient_encounter.select(
        F.col("name").alias("encounter"), "practitioner_name", "encounter_date", "encounter_time", "examination_detail"
    )
    note = F.concat(
        F.lit("<br>PractitionerName: <i>"), _text("practitioner_name"),
        F.lit(",</i> Speciality: <i>"), _text("department"),
        F.lit(",</i> DateofService: <i>"), _text("encounter_date"), F.lit(" "), _text("encounter_time"),
        F.lit("</i> <br>"), F.coalesce("examination_detail", F.lit("")), F.coalesce("drugs", F.lit("")),
    )
    place = F.struct("position", "creation", "encounter")
    return (
        billed.select("claim", "encounter", "position", "creation", "department")
        .join(visits, "encounter")
        .join(_drug_text(billed, t), "encounter", "left")
        .select("claim", place.alias("place"), note.alias("note"))
    )


def clinical_notes(frame: ClaimFrame, headers: DataFrame, run: RunContext) -> DataFrame:
    """(claim, clinical_notes): patient line, then a note per encounter; double quotes become spaces."""
    age = F.floor(F.datediff(run.today, "date_of_birth") / 365)
    patient_line = headers.select(
        F.col("name").alias("claim"),
        F.concat(
            F.lit("Patient: <b>"), _text("patient_name"), F.lit("</b>, Gender: <b>"), _text("gender"),
            F.lit("</b>, Date of Birth: <b>"), _text("date_of_birth"), F.lit("</b>, Age: <b>"),
            F.coalesce(age.cast("string"), F.lit("None")), F.lit(" years</b>,<br>"),
        ).alias("head"),
    )
    bodies = (
        _encounter_notes(frame.with_people(frame.billed), frame.t)
        .groupBy("claim")
        .agg(joined(F.collect_list(F.struct("place", "note")), "note", "").alias("body"))
    )
    return bodies.join(patient_line, "claim").select(
        "claim", F.translate(F.concat("head", "body"), '"', " ").alias("clinical_notes")
    )


def missing_examination(claims: DataFrame, t: Tables) -> DataFrame:
    """Encounters of the notes without examination detail."""
    blank = t.patient_encounter.filter(is_blank("examination_detail")).select(F.col("name").alias("encounter"))
    return note_encounters(claims, t).select("claim", "encounter").join(blank, "encounter")
