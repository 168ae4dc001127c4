"""Diseases of a claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import disease_code, violation
from wardledger.functions.joins import dealt_by
from wardledger.operators.claim_header import submitted_encounters
from wardledger.sources.schemas import CLAIM_DISEASE, shaped
from wardledger.sources.tables import Tables

# Diagnosis blocks of an encounter.
FINAL = "patient_encounter_final_diagnosis"
BLOCKS = {
    "patient_encounter_preliminary_diagnosis": ("Provisional Diagnosis", "Provisional"),
    FINAL: ("Final Diagnosis", "Final"),
}
# Fixed value: stored descriptions are cut to this length.
DESCRIPTION_LENGTH = 139


def claim_diseases(claims: DataFrame, t: Tables, encounters: DataFrame | None = None) -> DataFrame:
    """One row per claim, diagnosis block and medical code: the earliest entry, its description cut to the stored length.

    Descriptions are cut before they move, and not moved for a reader that shows none. The result lies by claim (``dealt_by``).

    ``encounters`` are the claims' submitted encounters, where they were kept before.
    """
    entries = t.codification_table.filter(
        (F.col("parenttype") == "Patient Encounter") & F.col("parentfield").isin(*BLOCKS)
    ).select(
        F.col("parent").alias("encounter"), (F.col("parentfield") == FINAL).alias("is_final"), "medical_code", "modified",
        F.col("name").alias("codification_table"), "code", F.substring("description", 1, DESCRIPTION_LENGTH).alias("description"),
    )
    if encounters is None:
        encounters = submitted_encounters(claims, t)
    encounters = encounters.select("claim", "encounter", "practitioner")
    # An entry meets all rows of its encounter, so the least description and practitioner of equal entries come of one row.
    entry = ["modified", "codification_table", "encounter", "code"]
    chosen = (
        dealt_by(entries.join(encounters, "encounter"), "claim")
        .groupBy("claim", "is_final", "medical_code")
        .agg(F.min(F.struct(*entry, "practitioner")).alias("entry"), F.min(F.struct(*entry, "description")).alias("described"))
        .select("claim", "is_final", "medical_code", "entry.*", "described.description")
    )
    provisional, final = BLOCKS.values()
    is_final = F.col("is_final")
    return shaped(
        chosen.withColumns(
            {
                "diagnosis_type": F.when(is_final, final[0]).otherwise(provisional[0]),
                "status": F.when(is_final, final[1]).otherwise(provisional[1]),
                "patient_encounter": F.col("encounter"),
                "disease_code": disease_code("code"),
                "item_crt_by": F.col("practitioner"),
                "date_created": F.to_date("modified"),
            }
        ),
        CLAIM_DISEASE,
    )


def normalized_codes(codes: DataFrame) -> DataFrame:
    """Distinct (code, disease_code) in the insurer's spelling."""
    return codes.select("code").distinct().withColumn("disease_code", disease_code("code"))


def missing_code_violations(claims: DataFrame, t: Tables) -> DataFrame:
    """Diagnoses of the claims that have no code to normalize."""
    uncoded = t.codification_table.filter(
        F.col("code").isNull()
        & (F.col("parenttype") == "Patient Encounter")
        & F.col("parentfield").isin(*BLOCKS)
    ).select(F.col("parent").alias("encounter"), "name")
    return (
        submitted_encounters(claims, t)
        .join(uncoded, "encounter")
        .select(*violation("claim", "disease_code", F.col("name")))
    )
