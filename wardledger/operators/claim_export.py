"""The folio document of a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import non_blank
from wardledger.session import Workspace

STRIPPED = "Stripped off"
_SPACE = " \t\n\r\u000b\f"


def _text(value: str) -> Column:
    """Dates and times as text; missing ones print as ``None``."""
    return F.coalesce(F.col(value).cast("string"), F.lit("None"))


def _disease_list(diseases: DataFrame) -> DataFrame:
    entry = F.struct(
        F.col("status").alias("Status"),
        F.col("disease_code").alias("DiseaseCode"),
        F.lit(None).cast("string").alias("Remarks"),
        F.col("item_crt_by").alias("CreatedBy"),
        _text("date_created").alias("DateCreated"),
    )
    first_provisional = F.col("status") == "Final"
    rows = F.array_sort(
        F.collect_list(F.struct(first_provisional.alias("a"), F.col("medical_code").alias("b"), entry.alias("entry")))
    )
    return diseases.groupBy("claim").agg(F.transform(rows, lambda r: r["entry"]).alias("FolioDiseases"))


def _item_list(items: DataFrame) -> DataFrame:
    entry = F.struct(
        F.col("item_code").alias("ItemCode"),
        F.col("item_quantity").cast("int").alias("ItemQuantity"),
        F.col("unit_price").alias("UnitPrice"),
        F.col("amount_claimed").alias("AmountClaimed"),
        non_blank("approval_ref_no").alias("ApprovalRefNo"),
        F.col("item_crt_by").alias("CreatedBy"),
        _text("date_created").alias("DateCreated"),
    )
    rows = F.array_sort(F.collect_list(F.struct("idx", F.col("ref_docname").alias("b"), entry.alias("entry"))))
    return items.groupBy("claim").agg(F.transform(rows, lambda r: r["entry"]).alias("FolioItems"))


# Field names of the folio document, in their given order, with the claim column.
_HEAD = [
    ("ClaimYear", "claim_year"), ("ClaimMonth", "claim_month"), ("FolioNo", "folio_no"),
    ("SerialNo", "serial_no"), ("FacilityCode", "facility_code"), ("CardNo", None),
    ("FirstName", "first_name"), ("LastName", "last_name"), ("Gender", "gender"),
    ("DateOfBirth", None), ("PatientFileNo", "patient_file_no"), ("ClaimFile", None),
    ("ClinicalNotes", "clinical_notes"), ("AuthorizationNo", "authorization_no"),
    ("AttendanceDate", None), ("PatientTypeCode", "patient_type_code"),
]
_TAIL = [
    ("PractitionerName", "practitioner_name"), ("PractitionerNo", "practitioner_no"),
    ("CreatedBy", "item_crt_by"), ("DateCreated", None), ("BillNo", "name"),
    ("LateSubmissionReason", "delayreason"),
]


def folio_documents(
    headers: DataFrame, diseases: DataFrame, items: DataFrame, notes: DataFrame, folio_nos: DataFrame
) -> DataFrame:
    """(claim, folio_json): one JSON document per claim, without the attached files.

    ``diseases`` and ``items`` are keyed by ``claim``, items ordered by ``idx``. Admission and
    discharge appear for inpatients only; empty fields are kept as null. The lists and notes are written one after the
    other, bucketed by claim, so the disk holds what is shuffled for one of them, and the documents are joined in place.
    """
    space = Workspace(headers.sparkSession, "zstd")
    disease_lists = space.keep(_disease_list(diseases), "diseases", by=("claim",))
    item_lists = space.keep(_item_list(items), "items", by=("claim",))
    notes = space.keep(notes.select("claim", "clinical_notes"), "notes", by=("claim",))
    special = {
        "CardNo": F.btrim("cardno", F.lit(_SPACE)),
        "DateOfBirth": _text("date_of_birth"),
        "ClaimFile": F.lit(STRIPPED),
        "AttendanceDate": _text("attendance_date"),
        "DateCreated": _text("posting_date"),
    }

    def fields(names: list[tuple[str, str | None]]) -> list[Column]:
        return [(F.col(c) if c else special[n]).alias(n) for n, c in names]

    stay = [
        F.concat(_text("date_admitted"), F.lit(" "), _text("admitted_time")).alias("DateAdmitted"),
        F.concat(_text("date_discharge"), F.lit(" "), _text("discharge_time")).alias("DateDischarged"),
    ]
    lists = [
        F.coalesce("FolioDiseases", F.array()).alias("FolioDiseases"),
        F.coalesce("FolioItems", F.array()).alias("FolioItems"),
        F.lit(STRIPPED).alias("PatientFile"),
    ]

    def document(entity: list[Column]) -> Column:
        return F.to_json(
            F.struct(F.array(F.struct(*entity)).alias("entities")), {"ignoreNullFields": "false"}
        )

    inpatient = document([*fields(_HEAD), *stay, *fields(_TAIL), *lists])
    outpatient = document([*fields(_HEAD), *fields(_TAIL), *lists])
    return (
        headers.withColumn("claim", F.col("name"))
        .join(disease_lists, "claim", "left")
        .join(item_lists, "claim", "left")
        .join(notes, "claim", "left")
        .join(folio_nos.select("claim", "folio_no"), "claim", "left")
        .select("claim", F.when(F.col("patient_type_code") == "IN", inpatient).otherwise(outpatient).alias("folio_json"))
    )
