"""Dispensed drugs written back to the prescriptions of their encounter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardledger.functions.columns import DOSAGE_KEYS, dosage_field, is_blank, stable_id
from wardledger.functions.joins import dealt_by
from wardledger.session import materialize
from wardledger.sources.tables import Tables

# A medication's fields for what its description does not say.
DEFAULTS = {
    "dosage": "default_prescription_dosage",
    "period": "default_prescription_duration",
    "dosage_form": "default_dosage_form",
    "interval": "default_interval",
    "interval_uom": "default_interval_uom",
    "comment": "default_comments",
}


def parsed_dosage(rows: DataFrame, text: str = "description") -> DataFrame:
    """Adds the six dosage fields found in a free text; NULL where the text has none."""
    return rows.withColumns({field: dosage_field(text, key) for field, key in DOSAGE_KEYS.items()})


def item_medications(t: Tables) -> DataFrame:
    """One medication per item, the first by name."""
    columns = ["medication_name", *DEFAULTS.values()]
    return (
        t.medication.groupBy(F.col("item").alias("item_code"))
        .agg(F.min(F.struct("name", *columns)).alias("m"))
        .select("item_code", F.lit(True).alias("linked"), F.col("m.name").alias("drug_code"), *[F.col(f"m.{c}").alias(c) for c in columns])
    )


def dosage_or_default(items: DataFrame, t: Tables) -> DataFrame:
    """Delivery items with their medication and its dosage: from the description, else the default."""
    known = items.join(item_medications(t), "item_code", "left")
    parsed = parsed_dosage(known)
    return parsed.withColumns({f: F.coalesce(f, d) for f, d in DEFAULTS.items()})


def _dispensing_notes(t: Tables) -> DataFrame:
    """Delivery notes of a patient's invoice and encounter."""
    return t.delivery_note.filter(
        ~is_blank("form_sales_invoice") & ~is_blank("patient") & ~is_blank("reference_name")
    ).select(
        F.col("name").alias("note"),
        F.col("reference_name").alias("encounter"),
        "company",
        F.col("set_warehouse").alias("warehouse"),
        "form_sales_invoice",
    )


def _first_diagnoses(t: Tables) -> DataFrame:
    """(encounter, medical_code): code and description of the first final diagnosis."""
    finals = t.codification_table.filter(
        (F.col("parenttype") == "Patient Encounter") & (F.col("parentfield") == "patient_encounter_final_diagnosis")
    )
    text = F.concat(
        F.coalesce("first.medical_code", F.lit("None")), F.lit("\n"), F.coalesce("first.description", F.lit("None"))
    )
    return (
        finals.groupBy(F.col("parent").alias("encounter"))
        .agg(F.min(F.struct("idx", "name", "medical_code", "description")).alias("first"))
        .select("encounter", text.alias("medical_code"))
    )


def dispensing_violations(t: Tables) -> DataFrame:
    """Notes that cannot be written back: an item without medication, or no final diagnosis."""
    medications = t.medication.select(F.col("item").alias("item_code")).distinct()
    unlinked = (
        t.delivery_note_item.select(F.col("parent").alias("note"), "item_code")
        .join(_dispensing_notes(t).select("note"), "note")
        .join(medications, "item_code", "left_anti")
        .select("note", F.lit("no_medication").alias("rule"), F.col("item_code").alias("detail"))
    )
    undiagnosed = (
        _dispensing_notes(t)
        .join(_first_diagnoses(t), "encounter", "left_anti")
        .select("note", F.lit("no_final_diagnosis").alias("rule"), F.col("encounter").alias("detail"))
    )
    return unlinked.unionByName(undiagnosed)


def accepted_items(t: Tables) -> DataFrame:
    """Items of the notes without violations, with their encounter's first diagnosis; a refused note changes nothing.

    Items look up their medication first and lie by note after that: a note that has an item without medication, or no
    final diagnosis, is found there (the rules of ``dispensing_violations``), so the items are read and moved once.
    """
    items = t.delivery_note_item.select(
        F.col("parent").alias("note"), "name", "idx", "item_code", "qty", "rate", "description", "reference_name"
    )
    linked = dealt_by(dosage_or_default(items, t).drop("description"), "note")
    notes = _dispensing_notes(t).join(_first_diagnoses(t), "encounter", "left")
    refused = F.bool_or(F.col("linked").isNull() | F.col("medical_code").isNull()).over(Window.partitionBy("note"))
    return linked.join(notes, "note").withColumn("_refused", refused).filter("not _refused").drop("_refused", "linked")


def dispensed_prescriptions(accepted: DataFrame, t: Tables) -> DataFrame:
    """New drug rows for accepted delivery items that were not prescribed."""
    pharmacies = (
        t.healthcare_service_unit.filter(F.col("service_unit_type") == "Pharmacy")
        .groupBy("company", "warehouse")
        .agg(F.min("name").alias("healthcare_service_unit"))
    )
    return (
        accepted.filter(is_blank("reference_name"))
        .join(pharmacies, ["company", "warehouse"], "left")
        .select(
            stable_id("encounter", "name").alias("name"),
            F.col("encounter").alias("parent"),
            "drug_code",
            F.col("medication_name").alias("drug_name"),
            "medical_code",
            F.lit(1).alias("prescribe"),
            *DEFAULTS,
            F.col("qty").alias("quantity"),
            F.col("rate").alias("amount"),
            F.col("name").alias("dn_detail"),
            F.lit(1).alias("drug_prescription_created"),
            F.col("qty").alias("delivery_quantity"),
            F.lit(1).alias("invoiced"),
            F.col("form_sales_invoice").alias("sales_invoice_number"),
            "healthcare_service_unit",
        )
    )


def undelivered_prescriptions(accepted: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Names of prescribed drug rows that a delivery note of their encounter did not deliver.

    One rule for stored and for newly dispensed rows, whatever the order of the notes.

    Notes per encounter are compared with notes per (encounter, drug), so a row is joined with two
    counts and not with the notes. All of it lies by encounter, where a map leads from its drugs to their counts.
    """
    delivered = dealt_by(accepted.select(F.col("encounter").alias("parent"), "note", "drug_code"), "parent").distinct()
    notes = delivered.groupBy("parent").agg(F.count_distinct("note").alias("notes"))
    deliveries = (
        delivered.filter(F.col("drug_code").isNotNull())
        .groupBy("parent", "drug_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("parent")
        .agg(F.map_from_entries(F.collect_list(F.struct("drug_code", "n"))).alias("deliveries"))
    )
    return (
        prescriptions.filter(F.col("prescribe") == 1)
        .select("name", "parent", "drug_code")
        .join(notes, "parent")
        .join(deliveries, "parent", "left")
        .filter(F.coalesce(F.try_element_at("deliveries", F.col("drug_code")), F.lit(0)) < F.col("notes"))
        .select("name")
    )


def updated_prescriptions(t: Tables) -> DataFrame:
    """The new drug prescription table: undelivered rows out, dispensed rows in."""
    accepted = materialize(accepted_items(t))
    rows = t.drug_prescription.unionByName(dispensed_prescriptions(accepted, t), allowMissingColumns=True)
    return rows.join(undelivered_prescriptions(accepted, rows), "name", "left_anti")
