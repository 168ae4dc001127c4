"""Reconciling repeated items, merging claims, and the original snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardledger.functions.columns import is_blank, joined, money_sum, non_blank, violation
from wardledger.functions.joins import dealt_by
from wardledger.operators.claim_header import claim_appointments

# Stored field names.
IDENTITY_COLUMNS = ("name", "owner", "creation", "modified", "modified_by", "docstatus")


def reconcile_items(items: DataFrame, recompute_amount: bool = False) -> DataFrame:
    """One row per (claim, item): the first row, with quantities and amounts added up.

    Approval numbers are joined in row order; encounters and references are joined as sets of whole
    strings. With ``recompute_amount`` (claim items, which are saved again) the amount is the first
    row's unit price times the added-up quantity. The result lies by claim (``dealt_by``).
    """
    merged = ["item_quantity", "amount_claimed", "approval_ref_no", "patient_encounter", "ref_docname", "status"]
    kept = [c for c in items.columns if c not in (*merged, "parent", "item_code", "idx", "name")]
    approval = F.when(~is_blank("approval_ref_no"), F.struct("idx", "name", "approval_ref_no"))
    grouped = dealt_by(items, "parent").groupBy("parent", "item_code").agg(
        F.min(F.struct("idx", "name", "status", *kept)).alias("first"),
        F.sum("item_quantity").cast("int").alias("item_quantity"),
        money_sum("amount_claimed").alias("amount_claimed"),
        joined(F.collect_list(approval), "approval_ref_no").alias("approval_ref_no"),
        F.array_join(F.array_sort(F.collect_set(non_blank("patient_encounter"))), ",").alias("patient_encounter"),
        F.array_join(F.array_sort(F.collect_set(non_blank("ref_docname"))), ",").alias("ref_docname"),
        F.max(F.when(F.col("status") == "Submitted", "Submitted")).alias("submitted"),
    )
    amount = F.col("first.unit_price") * F.col("item_quantity") if recompute_amount else F.col("amount_claimed")
    columns = {
        "parent": F.col("parent"),
        "item_code": F.col("item_code"),
        "item_quantity": F.col("item_quantity"),
        "amount_claimed": amount,
        "approval_ref_no": non_blank("approval_ref_no"),
        "patient_encounter": non_blank("patient_encounter"),
        "ref_docname": non_blank("ref_docname"),
        "status": F.coalesce("submitted", "first.status"),
    }
    return grouped.select(*[columns.get(c, F.col(f"first.{c}")).alias(c) for c in items.columns])


# The fields in which claims must agree to be merged.
MERGE_KEYS = ["patient", "attendance_date", "cardno", "coverage_plan_name"]


def merged_claims(claims: DataFrame) -> DataFrame:
    """Per patient, day, card and plan: the union of its claims' appointments as a JSON list.

    Claims without a patient are left out: they have nothing in common, and could be any number a day.
    """
    claims = claims.filter(~is_blank("patient"))
    appointments = claim_appointments(claims).select("claim", "appointment")
    heads = claims.select(F.col("name").alias("claim"), *MERGE_KEYS)
    listed = (
        appointments.join(heads, "claim")
        .groupBy(*MERGE_KEYS, "appointment")
        .agg(F.min("claim").alias("claim"))
        .groupBy(*MERGE_KEYS)
        .agg(F.array_sort(F.collect_list("appointment")).alias("appointments"))
    )
    counted = heads.groupBy(*MERGE_KEYS).agg(
        F.count(F.lit(1)).alias("claims"), F.min("claim").alias("claim")
    )
    same = [counted[k].eqNullSafe(listed[k]) for k in MERGE_KEYS]
    return counted.join(listed, same).select(
        "claim",
        *[counted[k] for k in MERGE_KEYS],
        F.col("claims").cast("int").alias("claims"),
        F.to_json("appointments").alias("claim_appointment_list"),
        F.lit(0).alias("allow_changes"),
    )


def mergeable_claims(claims: DataFrame) -> DataFrame:
    return merged_claims(claims).filter(F.col("claims") > 1)


def single_claim_violations(claims: DataFrame) -> DataFrame:
    """Merging was asked for a claim that has no partner, or no patient."""
    single = merged_claims(claims).filter(F.col("claims") == 1)
    return single.select(*violation("claim", "merge", F.col("patient"))).unionByName(
        claims.filter(is_blank("patient"))
        .withColumn("claim", F.col("name"))
        .select(*violation("claim", "merge_without_patient", F.col("patient")))
    )


def original_snapshot(items: DataFrame) -> DataFrame:
    """The items of new claims as their originals, without identity fields."""
    return items.drop(*IDENTITY_COLUMNS)


def missing_originals(items: DataFrame, originals: DataFrame, token_match: bool = False) -> DataFrame:
    """Claim items to be added to the originals: those whose reference no original names.

    An item's reference is compared as a whole with the originals' comma-separated names, so an item
    that joins several names is always added; ``token_match`` compares its names one by one and adds
    it if one of them is missing.
    """
    if not token_match:
        known = (
            originals.filter(~is_blank("ref_docname"))
            .select("parent", F.explode(F.split("ref_docname", ",")).alias("_reference"))
            .distinct()
        )
        missing = items.withColumn("_reference", F.col("ref_docname")).join(
            known, ["parent", "_reference"], "left_anti"
        )
        return missing.drop("_reference").drop(*IDENTITY_COLUMNS)
    # Names and items lie by claim, and what is known of them is found there: no row moves for it.
    names = dealt_by(items, "parent").select(
        "parent", F.explode_outer(F.split("ref_docname", ",")).alias("_reference"), F.coalesce("ref_docname", F.lit("")).alias("_whole"), F.lit(False).alias("_known")
    )
    named = dealt_by(originals.filter(~is_blank("ref_docname")), "parent").select(
        "parent", F.explode(F.split("ref_docname", ",")).alias("_reference"), F.lit(None).cast("string").alias("_whole"), F.lit(True).alias("_known")
    )
    unknown = (
        names.unionByName(named)
        .withColumn("_any", F.bool_or("_known").over(Window.partitionBy("parent", "_reference")))
        .filter("not _known and not _any and parent is not null")
        .select("parent", "_whole", F.lit(True).alias("_unknown"))
    )
    whole = dealt_by(items, "parent").withColumns({"_whole": F.coalesce("ref_docname", F.lit("")), "_unknown": F.lit(False)})
    return (
        whole.unionByName(unknown, allowMissingColumns=True)
        .withColumn("_missing", F.bool_or("_unknown").over(Window.partitionBy("parent", "_whole")))
        .filter("not _unknown and _missing")
        .select(*items.columns)
        .drop(*IDENTITY_COLUMNS)
    )
