"""What changed between a claim's original items and its submitted ones.

The originals are expected reconciled (``reconcile_items``), so a claim has one original per item
and the comparison is linear in the claim's items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardledger.functions.columns import non_blank, violation
from wardledger.functions.joins import dealt_by, spread_blank, spread_null
from wardledger.operators.prescriptions import DRUG, KINDS
from wardledger.options import RunContext
from wardledger.session import materialize
from wardledger.sources.schemas import CLAIM_CHANGE, shaped
from wardledger.sources.tables import Tables

APPOINTMENT = "Patient Appointment"
SERVICES = tuple(k.ref_doctype for k in KINDS if k.ref_doctype != DRUG)
STAYS = {"Inpatient Consultancy": "inpatient_consultancy", "Inpatient Occupancy": "inpatient_occupancy"}
RETURNS = "LRPMT Returns"

# The fields of a change that come from the item or from the lookups.
EVENT = [
    "claim", "item_code", "item_name", "quantity", "status", "previous_amount", "current_amount",
    "ref_docname", "ref_doctype", "patient_encounter", "lrpmt_return", "medication_change_request",
]


def _events(df: DataFrame, **columns: Column) -> DataFrame:
    nothing = F.lit(None).cast("string")
    defaults = {"lrpmt_return": nothing, "medication_change_request": nothing}
    named = {**defaults, **columns}
    return df.select(*[named.get(c, F.col(c)).alias(c) for c in EVENT])


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _amount(column: str) -> Column:
    return F.coalesce(column, F.lit(0.0))


_FIELDS = ["idx", "item_code", "item_name", "quantity", "amount_claimed", "ref_docname", "ref_doctype", "patient_encounter"]


def compared(originals: DataFrame, items: DataFrame) -> DataFrame:
    """Originals and claim items (``is_item``) as rows of one frame that lies by claim (``dealt_by``).

    ``claimed`` says if the claim has an item of the row's code, ``previous`` holds the amounts of the claim's originals
    of that code. Both are found within the claim, so no row moves again; a join of the two sides would move them by
    claim and code. Items may be codes only, the other fields are NULL then.
    """
    def keyed(side: DataFrame, is_item: bool) -> DataFrame:
        rows = dealt_by(side.withColumnRenamed("item_quantity", "quantity"), "parent")
        fields = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in _FIELDS]
        return rows.select(F.col("parent").alias("claim"), F.lit(is_item).alias("is_item"), _key("item_code").alias("_item"), *fields)

    same = Window.partitionBy("claim", "_item")
    known = F.col("claim").isNotNull()
    return keyed(originals, False).unionByName(keyed(items, True)).select(
        "claim", "is_item", *_FIELDS,
        (known & F.bool_or("is_item").over(same)).alias("claimed"),
        F.when(known, F.collect_list(F.when(~F.col("is_item"), _amount("amount_claimed"))).over(same)).alias("previous"),
    )


def _amount_changes(rows: DataFrame) -> DataFrame:
    both = rows.filter("is_item").select(
        "claim", *[c for c in _FIELDS if c != "amount_claimed"],
        F.explode("previous").alias("previous_amount"), _amount("amount_claimed").alias("current_amount"),
    )
    return _events(both.filter(F.col("previous_amount") != F.col("current_amount")), status=F.lit("Amount Changed"))


def amount_changes(originals: DataFrame, items: DataFrame) -> DataFrame:
    """Claim items whose amount differs from the original of the same item."""
    return _amount_changes(compared(originals, items))


#: What is kept of a removed original.
_KEPT = ["item_code", "item_name", "quantity", "ref_docname", "ref_doctype", "patient_encounter", "previous_amount", "current_amount"]


def _marked(rows: DataFrame) -> DataFrame:
    """The originals, with ``seen`` if one of their claim's claimed originals has their reference."""
    amount = F.col("amount_claimed")
    return (
        rows.filter("not is_item")
        .withColumns({"reference": _key("ref_docname"), "previous_amount": amount, "current_amount": amount})
        .withColumn("seen", F.bool_or("claimed").over(Window.partitionBy("claim", "reference")))
    )


def marked_originals(originals: DataFrame, items: DataFrame) -> DataFrame:
    """Every original, ``claimed`` or not, and ``seen`` or not; of the items only the codes are read."""
    codes = dealt_by(items.select("parent", "item_code"), "parent").distinct()
    return _marked(compared(originals, codes))


def seen_references(originals: DataFrame, items: DataFrame) -> DataFrame:
    """(claim, reference): references of originals whose item is still claimed."""
    return marked_originals(originals, items).filter("claimed").select("claim", "reference").distinct()


def _removed(marked: DataFrame) -> DataFrame:
    return marked.filter("not claimed and not seen").select("claim", "idx", *_KEPT)


def removed_originals(originals: DataFrame, items: DataFrame) -> DataFrame:
    """Originals whose reference was not seen, as unchanged-amount events without a status.

    An original whose item is still claimed has been seen itself, so only the others are looked up.
    """
    return _removed(marked_originals(originals, items))


def removed_appointments(removed: DataFrame) -> DataFrame:
    return _events(removed.filter(F.col("ref_doctype") == APPOINTMENT), status=F.lit("Item Removed"))


def removed_names(marked: DataFrame) -> DataFrame:
    """Removed originals (of ``marked_originals``) per single reference name.

    A name is looked at once per claim, for the first original that has it, across all record
    types; names already seen are skipped. Removed and seen names meet in one aggregation, within their claim.
    """
    routed = F.col("ref_doctype").isin(DRUG, *SERVICES, *STAYS)
    names = F.when(F.col("claimed"), F.array("reference")).when(~F.col("seen") & routed, F.split("reference", ","))
    return (
        marked.select("*", F.posexplode(names).alias("_at", "name"))
        .select("claim", "name", "claimed", F.when(~F.col("claimed"), F.struct("idx", "_at", *_KEPT)).alias("row"))
        .groupBy("claim", "name")
        .agg(F.min("row").alias("row"), F.bool_or("claimed").alias("claimed"))
        .filter("not claimed")
        .select("claim", "name", *[F.col(f"row.{c}").alias(c) for c in _KEPT])
    )


def _return_documents(t: Tables) -> DataFrame:
    """One return document per (is_drug, name, encounter), where both are known."""
    tagged = [
        returns.filter((F.col("parentfield") == field) & (F.col("parenttype") == RETURNS)).select(
            F.lit(field == "drug_items").alias("is_drug"), F.col("child_name").alias("name"), F.col("encounter_no").alias("child_encounter"), "parent"
        )
        for returns, field in ((t.medication_return, "drug_items"), (t.item_return, "lrpt_items"))
    ]
    rows = reduce(DataFrame.unionByName, tagged).filter("name is not null and child_encounter is not null")
    return rows.groupBy("is_drug", "name", "child_encounter").agg(F.min("parent").alias("return_document"))


def change_requests(t: Tables) -> DataFrame:
    """(item_name, encounter, medication_change_request): one request per drug and encounter."""
    drugs = t.medication_change_request_drug.filter(
        (F.col("parenttype") == "Medication Change Request")
        & (F.col("parentfield") == "original_pharmacy_prescription")
    ).select(F.col("parent").alias("request"), F.col("drug_name").alias("item_name"))
    requests = t.medication_change_request.select(
        F.col("name").alias("request"), F.col("patient_encounter").alias("patient_encounter")
    )
    return (
        requests.join(drugs, "request")
        .groupBy("item_name", "patient_encounter")
        .agg(F.min("request").alias("medication_change_request"))
    )


def _cancelled_or_removed() -> Column:
    """Status of a found prescription; a cancelled one without a return document is no change."""
    return F.when(F.col("is_cancelled") == 0, "Item Removed").when(
        (F.col("is_cancelled") == 1) & F.col("return_document").isNotNull(), "Item Cancelled"
    )


def _current_rows(t: Tables) -> DataFrame:
    """The rows that names refer to, of all record types: (ref_doctype, name, is_cancelled, is_confirmed, child_encounter)."""
    prescribed = [
        t.get(k.table).select(
            F.lit(k.ref_doctype).alias("ref_doctype"), "name", "is_cancelled", F.lit(None).cast("int").alias("is_confirmed"), F.col("parent").alias("child_encounter")
        )
        for k in KINDS
    ]
    stays = [
        t.get(table).select(
            F.lit(doctype).alias("ref_doctype"), "name", F.lit(None).cast("int").alias("is_cancelled"), "is_confirmed", F.lit(None).cast("string").alias("child_encounter")
        )
        for doctype, table in STAYS.items()
    ]
    return reduce(DataFrame.unionByName, [*prescribed, *stays])


def removals(names: DataFrame, t: Tables) -> DataFrame:
    """What became of each removed name, by one lookup for all record types.

    Drugs: removed, cancelled by a return, or replaced by a change request. Other services: removed, or cancelled by a
    return; unknown ones are no change. Beds and consultancies: unconfirmed ones by name, others removed with their
    whole reference.
    """
    doctype = F.col("ref_doctype")
    is_drug, is_stay = doctype == DRUG, doctype.isin(*STAYS)
    known = _current_rows(t).withColumn("known", F.lit(True)).withColumnRenamed("name", "_name")
    rows = (
        names.withColumns({"is_drug": is_drug, "_name": spread_blank("name", "claim")})
        .join(known, ["ref_doctype", "_name"], "left")
        .withColumn("child_encounter", F.when(~is_stay, F.col("child_encounter")))
        .withColumn("_encounter", spread_null("child_encounter", "_name"))
        .join(_return_documents(t).withColumnsRenamed({"child_encounter": "_encounter", "name": "_name"}), ["is_drug", "_name", "_encounter"], "left")
    )
    missing = F.col("child_encounter").isNull()
    unconfirmed = F.coalesce(F.col("is_confirmed") == 0, F.lit(False))
    replaced = is_drug & missing
    rows = (
        rows.withColumn("_drug", spread_null(F.when(replaced, F.col("item_name")), "_name"))
        .join(change_requests(t).withColumnRenamed("item_name", "_drug"), ["_drug", "patient_encounter"], "left")
        .withColumn(
            "status",
            F.when(is_stay, F.when(unconfirmed, "Item Unconfirmed").otherwise("Item Removed"))
            .when(replaced, F.when(F.col("medication_change_request").isNotNull(), "Item Replaced"))
            .when(F.col("known"), _cancelled_or_removed()),
        )
        .filter(F.col("status").isNotNull())
    )
    named = ~is_stay | unconfirmed
    own_encounter = F.when(is_drug, F.col("child_encounter")).otherwise(non_blank("child_encounter"))
    return _events(
        rows,
        ref_docname=F.when(named, F.col("name")).otherwise(F.col("ref_docname")),
        patient_encounter=F.coalesce(own_encounter, "patient_encounter"),
        lrpmt_return=F.when(F.col("status") == "Item Cancelled", F.col("return_document")),
        medication_change_request=F.when(F.col("status") == "Item Replaced", F.col("medication_change_request")),
    )


def drug_removals(names: DataFrame, t: Tables) -> DataFrame:
    """Removed drugs: removed, cancelled by a return, or replaced by a change request."""
    return removals(names.filter(F.col("ref_doctype") == DRUG), t)


def service_removals(names: DataFrame, t: Tables) -> DataFrame:
    """Removed lab, radiology, procedure and therapy items: removed, or cancelled by a return."""
    return removals(names.filter(F.col("ref_doctype").isin(*SERVICES)), t)


def stay_removals(names: DataFrame, t: Tables) -> DataFrame:
    """Removed beds and consultancies: unconfirmed ones by name, others with their whole reference."""
    return removals(names.filter(F.col("ref_doctype").isin(*STAYS)), t)


def unknown_service_violations(names: DataFrame, t: Tables) -> DataFrame:
    """Removed services whose prescription does not exist."""
    return (
        names.filter(F.col("ref_doctype").isin(*SERVICES))
        .join(_current_rows(t), ["ref_doctype", "name"], "left_anti")
        .select(*violation("claim", "unknown_prescription", F.col("name")))
    )


def change_records(events: DataFrame, headers: DataFrame, run: RunContext) -> DataFrame:
    """Events as change records, with the claim's period and company and the run's time and user."""
    heads = headers.select(
        F.col("name").alias("claim"), "claim_month", "claim_year", "company", "patient_appointment"
    )
    previous, current = _amount("previous_amount"), _amount("current_amount")
    return shaped(
        events.join(heads, "claim", "left").withColumns(
            {
                "insurance_claim": F.col("claim"),
                "posting_date": run.today,
                "posting_time": run.time_text,
                "amount_changed": F.abs(previous - current),
                "user_email": F.lit(run.user_email),
                "edited_by": F.lit(run.user_name),
            }
        ),
        CLAIM_CHANGE,
    )


def track_changes(
    originals: DataFrame, items: DataFrame, headers: DataFrame, t: Tables, run: RunContext
) -> DataFrame:
    """All change records of submitted claims, from reconciled originals and claim items.

    Originals and items meet once and are kept by claim, as changed, seen and removed ones are read from them. Of
    ``headers`` only the columns of ``claim_periods`` are used.
    """
    rows = materialize(compared(originals, items), by=("claim",))
    marked = _marked(rows)
    events = [
        _amount_changes(rows),
        removed_appointments(_removed(marked)),
        removals(removed_names(marked), t),
    ]
    return change_records(reduce(DataFrame.unionByName, events), headers, run)
