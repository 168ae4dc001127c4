"""The five prescription tables as one, and what the performed service says about each row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import is_blank
from wardledger.functions.joins import dealt_by, spread_blank, spread_null
from wardledger.sources.tables import Tables

DOSAGE_COLUMNS = (
    "dosage", "period", "dosage_form", "interval", "interval_uom", "medical_code", "comment",
)


@dataclass(frozen=True)
class Kind:
    table: str
    ref_doctype: str
    template_type: str
    template: str
    label: str
    document_type: str | None = None
    document: str | None = None
    has_quantity: bool = False


# Record types and field names of the prescription tables, in their given order.
KINDS = (
    Kind("lab_prescription", "Lab Prescription", "Lab Test Template",
         "lab_test_code", "lab_test_name", "Lab Test", "lab_test"),
    Kind("radiology_prescription", "Radiology Procedure Prescription", "Radiology Examination Template",
         "radiology_examination_template", "radiology_procedure_name",
         "Radiology Examination", "radiology_examination"),
    Kind("procedure_prescription", "Procedure Prescription", "Clinical Procedure Template",
         "procedure", "procedure_name", "Clinical Procedure", "clinical_procedure"),
    Kind("drug_prescription", "Drug Prescription", "Medication",
         "drug_code", "drug_name", "Delivery Note Item", "dn_detail", True),
    Kind("therapy_plan_detail", "Therapy Plan Detail", "Therapy Type", "therapy_type", "therapy_type"),
)
DRUG, LAB, THERAPY = "Drug Prescription", "Lab Prescription", "Therapy Plan Detail"


def kind_field(field: str) -> Column:
    """A fixed value of a row's kind, found by its ``table_order``: rows that move carry that number, not the texts."""
    return F.element_at(F.array(*[F.lit(getattr(k, field)).cast("string") for k in KINDS]), F.col("table_order") + 1)


def _kind_of(field: str, value: str) -> Column:
    """The ``table_order`` of the kind that has this value; NULL where none has."""
    given = {getattr(k, field): i for i, k in enumerate(KINDS) if getattr(k, field)}
    return F.element_at(F.create_map(*[F.lit(x) for pair in given.items() for x in pair]), F.col(value))


def _projection(t: Tables, position: int, kind: Kind) -> DataFrame:
    def column(name: str | None, type_name: str = "string") -> Column:
        return F.col(name) if name else F.lit(None).cast(type_name)

    drug = kind.has_quantity
    return t.get(kind.table).select(
        F.lit(position).alias("table_order"),
        F.lit(kind.ref_doctype).alias("ref_doctype"),
        F.lit(kind.template_type).alias("template_type"),
        F.col(kind.template).alias("template"),
        F.col(kind.label).alias("display_name"),
        "name",
        "parent",
        "idx",
        "amount",
        column("quantity" if drug else None, "double").alias("quantity"),
        column("quantity_returned" if drug else None, "double").alias("quantity_returned"),
        "prescribe",
        "is_cancelled",
        "is_not_available_inhouse",
        F.lit(kind.document_type).cast("string").alias("document_type"),
        column(kind.document).alias("document"),
        "modified",
        *[column(c if drug else None).alias(c) for c in DOSAGE_COLUMNS],
    )


def prescriptions(t: Tables) -> DataFrame:
    """All prescription rows, tagged with their record type, template and reference document."""
    return reduce(DataFrame.unionByName, [_projection(t, i, k) for i, k in enumerate(KINDS)])


def with_item(rows: DataFrame, t: Tables) -> DataFrame:
    """Adds ``item_code`` through the template. Rows without their ``template_type`` meet it by ``table_order``."""
    typed = "template_type" in rows.columns
    kind = "template_type" if typed else "table_order"
    types = F.col("template_type") if typed else _kind_of("template_type", "template_type").alias(kind)
    templates = t.item_template.select(types, F.col("name").alias("_template"), F.col("item").alias("item_code"))
    return (
        rows.withColumn("_template", spread_blank("template", "name"))
        .join(templates, [kind, "_template"], "left")
        .drop("_template")
    )


def looked_up_in_place(rows: DataFrame, t: Tables) -> DataFrame:
    """``with_item`` and ``with_approval`` of written rows that lie by ``parent`` and stay there.

    Only the different templates and documents of each encounter move, and what was found for them comes back to it.
    """
    templates = t.item_template.select(
        _kind_of("template_type", "template_type").alias("table_order"), F.col("name").alias("template"), F.col("item").alias("item_code")
    )
    approvals = t.approval.groupBy(_kind_of("document_type", "ref_doctype").alias("table_order"), F.col("ref_docname").alias("document")).agg(
        F.min("approval_number").alias("approval_ref_no")
    )
    found = rows.join(_by_encounter(rows, templates, "template"), "parent", "left").join(_by_encounter(rows, approvals, "document"), "parent", "left")

    def matches(name: str) -> Column:
        same = lambda e: (e["table_order"] == F.col("table_order")) & (e[name] == F.col(name))
        return F.filter(f"_{name}s", same)

    codes = F.transform(matches("template"), lambda e: e["item_code"])
    columns = [*rows.columns, F.try_element_at(matches("document"), F.lit(1))["approval_ref_no"].alias("approval_ref_no")]
    return found.select(*columns, F.explode_outer(codes).alias("item_code"))


def _by_encounter(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """(parent, _names): what is ``known`` of the different (table_order, name) of each encounter, in a list."""
    wanted = rows.filter(~is_blank(name)).select("parent", "table_order", name).distinct()
    found = dealt_by(wanted.join(known, ["table_order", name]), "parent")
    entry = F.struct("table_order", *known.columns[1:])
    return found.groupBy("parent").agg(F.collect_list(entry).alias(f"_{name}s"))


def with_status(rows: DataFrame, t: Tables) -> DataFrame:
    """Adds ``status`` (``status_of``), looking up the lab tests of each row's encounter."""
    tests = lab_tests_under_way(t).withColumnRenamed("parent", "_parent")
    found = rows.withColumn("_parent", spread_null("parent", "name")).join(tests, "_parent", "left")
    return found.withColumn("status", status_of()).drop("_parent", "under_way")


def lab_tests_under_way(t: Tables) -> DataFrame:
    """(parent, under_way): the names of the prescriptions of each encounter that have a lab test under way."""
    state = F.min_by("workflow_state", "name")
    return (
        dealt_by(t.lab_test.filter((F.col("ref_doctype") == "Patient Encounter") & F.col("ref_docname").isNotNull()), "ref_docname")
        .groupBy(F.col("ref_docname").alias("parent"), "ref_childname")
        .agg(state.alias("state"))
        .filter(~is_blank("state") & (F.col("state") != "Lab Test Requested") & ~is_blank("ref_childname"))
        .groupBy("parent")
        .agg(F.collect_list("ref_childname").alias("under_way"))
    )


def status_of() -> Column:
    """``Submitted`` where the service was done or a lab test is under way (``under_way`` of the row's encounter).

    Only lab rows without a reference document look for a lab test by their own name.
    """
    kind = kind_field("ref_doctype")
    waiting = (kind == LAB) & is_blank("document")
    under_way = F.coalesce(F.array_contains("under_way", F.col("name")), F.lit(False))
    done = (kind == THERAPY) | ~is_blank("document") | (waiting & under_way)
    return F.when(done, "Submitted").otherwise("Draft")


def with_approval(rows: DataFrame, t: Tables) -> DataFrame:
    """Adds ``approval_ref_no`` of the reference document; rows without one are not moved.

    Rows without their ``document_type`` meet it by ``table_order``.
    """
    typed = "document_type" in rows.columns
    kind = "document_type" if typed else "table_order"
    types = F.col("ref_doctype") if typed else _kind_of("document_type", "ref_doctype")
    approvals = t.approval.groupBy(types.alias(kind), F.col("ref_docname").alias("_document")).agg(
        F.min("approval_number").alias("approval_ref_no")
    )
    named = (F.col(kind) if typed else kind_field("document_type")).isNotNull() & ~is_blank("document")
    found = rows.filter(named).withColumn("_document", F.col("document")).join(approvals, [kind, "_document"], "left").drop("_document")
    none = F.lit(None).cast(approvals.schema["approval_ref_no"].dataType)
    return found.unionByName(rows.filter(~named).withColumn("approval_ref_no", none))
