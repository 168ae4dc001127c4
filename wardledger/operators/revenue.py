"""Revenue report: monthly revenue by practitioner, unit, plan and speciality.

Every branch filters, joins, then aggregates to (month, practitioner, units, plan, ...), so what is
shuffled last is already partially aggregated on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import money, money_sum, month_name, month_start
from wardledger.functions.joins import spread_blank, spread_null
from wardledger.options import ReportFilters
from wardledger.sources.schemas import REVENUE, shaped
from wardledger.sources.tables import Tables

# Department labels of the prescription branches, with their source table and the
# document that says whether the service was performed (table, reference field).
DOCUMENTED = {
    "Lab": ("lab_prescription", "lab_test", "lab_test"),
    "Radiology": ("radiology_prescription", "radiology_examination", "radiology_examination"),
    "Clinical Procedure": ("procedure_prescription", "clinical_procedure", "clinical_procedure"),
}
UNDOCUMENTED = {"Medication": "drug_prescription", "Therapy": "therapy_plan_detail"}
DEPARTMENTS = (*DOCUMENTED, *UNDOCUMENTED)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _practitioners(t: Tables) -> DataFrame:
    """Practitioners with their main department."""
    hp = t.healthcare_practitioner.select(
        F.col("name").alias("healthcare_practitioner"),
        "healthcare_practitioner_type",
        F.col("department").alias("speciality"),
    )
    md = t.medical_department.select(F.col("name").alias("speciality"), "main_department")
    return hp.join(md, "speciality", "left")


def _labelled(df: DataFrame, **columns) -> DataFrame:
    """Year and month from the group's month, constant labels, report columns."""
    return shaped(
        df.withColumn("year", F.year("period"))
        .withColumn("month", month_name("period"))
        .withColumns({k: v if not isinstance(v, str) else F.lit(v) for k, v in columns.items()}),
        REVENUE,
    )


def consultation_revenue(t: Tables, filters: ReportFilters) -> DataFrame:
    """Paid amounts of closed, insured, first-time appointments."""
    visits = t.in_months("patient_appointment", filters).filter(
        (F.col("status") == "Closed")
        & (F.col("insurance_subscription") != "")
        & (F.col("follow_up") == 0)
        & filters.date_range("appointment_date")
        & filters.same_company()
    ).select(
        month_start("appointment_date").alias("period"),
        F.col("practitioner").alias("healthcare_practitioner"),
        F.col("service_unit").alias("practitioner_hsu"),
        F.col("coverage_plan_name").alias("payment_mode"),
        "paid_amount",
    )
    keys = [
        "period", "healthcare_practitioner", "healthcare_practitioner_type", "practitioner_hsu",
        "payment_mode", "speciality", "main_department",
    ]
    grouped = (
        visits.join(_practitioners(t), "healthcare_practitioner")
        .groupBy(*keys)
        .agg(money_sum("paid_amount").alias("amount"))
    )
    return _labelled(
        grouped,
        department_hsu=F.col("practitioner_hsu"),
        department="Consultation",
        status="Submitted",
    )


def _encounters(t: Tables, filters: ReportFilters) -> DataFrame:
    """Encounters of the report; drafts count only in a report without a company."""
    wanted = filters.date_range("encounter_date") & filters.same_company()
    if filters.company:
        wanted = wanted & (F.col("docstatus") == 1)
    return (
        t.in_months("patient_encounter", filters).filter(wanted)
        .select(
            F.col("name").alias("parent"),
            month_start("encounter_date").alias("period"),
            F.col("practitioner").alias("healthcare_practitioner"),
            F.col("healthcare_service_unit").alias("practitioner_hsu"),
            F.col("insurance_coverage_plan").alias("payment_mode"),
        )
        .join(_practitioners(t), "healthcare_practitioner")
    )


def _billable(prescriptions: DataFrame) -> DataFrame:
    return prescriptions.filter(
        (F.col("is_not_available_inhouse") == 0) & (F.col("is_cancelled") == 0) & (F.col("prescribe") == 0)
    )


def _documented_rows(t: Tables, encounters: DataFrame, departments: list[str]) -> DataFrame:
    rows, documents = [], []
    for label in departments:
        table, document, field = DOCUMENTED[label]
        rows.append(
            _billable(t.get(table)).select(
                "parent",
                F.lit(label).alias("department"),
                "department_hsu",
                "amount",
                spread_blank(field, "name").alias("document"),
            )
        )
        documents.append(
            t.get(document).select(
                F.lit(label).alias("department"),
                F.col("name").alias("document"),
                F.col("docstatus").alias("status_key"),
            )
        )
    return (
        _union(rows).join(encounters, "parent").join(_union(documents), ["department", "document"], "left").drop("document")
    )


def _undocumented_rows(t: Tables, encounters: DataFrame, departments: list[str]) -> DataFrame:
    rows = []
    if "Medication" in departments:
        rows.append(
            _billable(t.drug_prescription).select(
                "parent",
                F.lit("Medication").alias("department"),
                F.col("healthcare_service_unit").alias("department_hsu"),
                (F.col("amount") * (F.col("quantity") - F.col("quantity_returned"))).alias("amount"),
                F.col("dn_detail").isNotNull().cast("int").alias("status_key"),
            )
        )
    if "Therapy" in departments:
        rows.append(
            _billable(t.therapy_plan_detail).select(
                "parent",
                F.lit("Therapy").alias("department"),
                "department_hsu",
                "amount",
                F.lit(1).alias("status_key"),
            )
        )
    return _union(rows).join(encounters, "parent")


def prescription_revenue(
    t: Tables, filters: ReportFilters, departments: tuple[str, ...] = DEPARTMENTS
) -> DataFrame:
    """Revenue of the chosen prescription kinds in one aggregation.

    Rows are grouped by the raw status of the reference document, so several ``Draft`` rows with the
    same visible keys may appear.
    """
    encounters = _encounters(t, filters)
    parts = []
    documented = [d for d in departments if d in DOCUMENTED]
    undocumented = [d for d in departments if d in UNDOCUMENTED]
    if documented:
        parts.append(_documented_rows(t, encounters, documented))
    if undocumented:
        parts.append(_undocumented_rows(t, encounters, undocumented))
    keys = [
        "department", "period", "healthcare_practitioner", "healthcare_practitioner_type",
        "practitioner_hsu", "department_hsu", "payment_mode", "speciality", "main_department",
        "status_key",
    ]
    grouped = _union(parts).groupBy(*keys).agg(money_sum("amount").alias("amount"))
    return _labelled(grouped, status=F.when(F.col("status_key") == 1, "Submitted").otherwise("Draft"))


def lab_revenue(t: Tables, filters: ReportFilters) -> DataFrame:
    return prescription_revenue(t, filters, ("Lab",))


def radiology_revenue(t: Tables, filters: ReportFilters) -> DataFrame:
    return prescription_revenue(t, filters, ("Radiology",))


def procedure_revenue(t: Tables, filters: ReportFilters) -> DataFrame:
    return prescription_revenue(t, filters, ("Clinical Procedure",))


def drug_revenue(t: Tables, filters: ReportFilters) -> DataFrame:
    return prescription_revenue(t, filters, ("Medication",))


def therapy_revenue(t: Tables, filters: ReportFilters) -> DataFrame:
    return prescription_revenue(t, filters, ("Therapy",))


def _insured_stays(t: Tables, filters: ReportFilters) -> DataFrame:
    """Insured inpatient records of the company with the plan of their appointment."""
    plans = t.patient_appointment.select(
        F.col("name").alias("patient_appointment"), F.col("coverage_plan_name").alias("payment_mode")
    )
    return (
        t.inpatient_record.filter((F.col("insurance_subscription") != "") & filters.same_company())
        .select(
            F.col("name").alias("parent"),
            "patient_appointment",
            month_start("admitted_datetime").alias("admitted_month"),
        )
        .join(plans, "patient_appointment")
    )


def bed_revenue(t: Tables, filters: ReportFilters) -> DataFrame:
    """Confirmed bed occupancies, grouped by month of admission, shown under the earliest check-in."""
    filters.require_all("bed_revenue")
    stays = t.in_months("inpatient_occupancy", filters).filter(
        (F.col("is_confirmed") == 1) & filters.instant_range("check_in")
    ).select("parent", F.col("service_unit").alias("department_hsu"), "check_in", "amount")
    types = t.healthcare_service_unit_type.select(
        F.col("name").alias("service_unit_type"), F.col("item_group").alias("speciality")
    )
    units = t.healthcare_service_unit.select(
        F.col("name").alias("department_hsu"), "service_unit_type"
    ).join(types, "service_unit_type")
    grouped = (
        stays.join(_insured_stays(t, filters), "parent")
        .join(units, "department_hsu")
        .groupBy("admitted_month", "department_hsu", "speciality", "payment_mode")
        .agg(money_sum("amount").alias("amount"), F.min("check_in").cast("date").alias("period"))
    )
    nothing = F.lit(None).cast("string")
    return _labelled(
        grouped,
        healthcare_practitioner=nothing,
        healthcare_practitioner_type=nothing,
        practitioner_hsu=nothing,
        main_department=nothing,
        department="IPD",
        status="Confirmed",
    )


def consultancy_revenue(t: Tables, filters: ReportFilters) -> DataFrame:
    """Confirmed inpatient consultancies.

    Consultancies name an item by its display name, and each item of that name counts. The items
    are first counted per (name, group) and the rates multiplied, so no duplicate rows are made.
    """
    filters.require_all("consultancy_revenue")
    visits = t.in_months("inpatient_consultancy", filters).filter(
        (F.col("is_confirmed") == 1) & filters.date_range("date")
    ).select(
        "parent", "date", "consultation_item", "rate", spread_blank("encounter", "name").alias("encounter")
    )
    items = (
        t.item.groupBy(F.col("item_name").alias("consultation_item"), F.col("item_group").alias("speciality"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    practitioners = t.healthcare_practitioner.select(F.col("name").alias("_who"), "healthcare_practitioner_type")
    encounters = t.patient_encounter.select(
        F.col("name").alias("encounter"),
        F.col("practitioner").alias("healthcare_practitioner"),
        F.col("healthcare_service_unit").alias("practitioner_hsu"),
    )
    keys = [
        "admitted_month", "healthcare_practitioner", "healthcare_practitioner_type", "speciality",
        "practitioner_hsu", "payment_mode",
    ]
    grouped = (
        visits.join(_insured_stays(t, filters), "parent")
        .join(items, "consultation_item")
        .join(encounters, "encounter", "left")
        .withColumn("_who", spread_null("healthcare_practitioner", "encounter"))
        .join(practitioners, "_who", "left")
        .groupBy(*keys)
        .agg(
            F.sum(money("rate") * F.col("copies")).cast("double").alias("amount"),
            F.min("date").alias("period"),
        )
    )
    nothing = F.lit(None).cast("string")
    return _labelled(
        grouped, department_hsu=nothing, main_department=nothing, department="IPD", status="Confirmed"
    )


def cash_revenue(t: Tables, filters: ReportFilters) -> DataFrame:
    """Cash invoices: point-of-sale ones, and others of a known patient, as separate rows."""
    invoices = t.in_months("sales_invoice", filters).filter(
        ((F.col("is_pos") == 1) | ((F.col("is_pos") == 0) & (F.col("patient") != "")))
        & filters.date_range("posting_date")
        & filters.same_company()
    ).select(F.col("name").alias("parent"), "is_pos", month_start("posting_date").alias("period"))
    items = t.sales_invoice_item.filter(F.col("docstatus") == 1).select(
        "parent",
        "healthcare_practitioner",
        F.col("healthcare_service_unit").alias("department_hsu"),
        F.col("item_group").alias("department"),
        "amount",
    )
    grouped = (
        items.join(invoices, "parent")
        .groupBy("is_pos", "period", "healthcare_practitioner", "department_hsu", "department")
        .agg(money_sum("amount").alias("amount"))
    )
    nothing = F.lit(None).cast("string")
    return _labelled(
        grouped,
        healthcare_practitioner_type=nothing,
        practitioner_hsu=nothing,
        payment_mode="Cash",
        speciality=nothing,
        main_department=nothing,
        status="Submitted",
    )


def with_grand_total(report: DataFrame) -> DataFrame:
    """The report's rows and one row with their total amount: two sets of groups from one pass over the report.

    Each row enters as itself and as a part of the total. Rows of the report that agree in every column are one group,
    counted and repeated. The total is there, and empty, for a report without rows too.
    """
    names = REVENUE.names
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in REVENUE.fields}

    def entry(is_total: bool, values: dict[str, Column], part: Column) -> Column:
        columns = [value.alias(name) for name, value in values.items()]
        return F.struct(F.lit(is_total).alias("_is_total"), *columns, money(part).alias("_part"))

    total = nothing | {"department": F.lit("Total")}
    own = {name: F.col(name) for name in names}
    entries = report.select(F.inline(F.array(entry(False, own, F.lit(None)), entry(True, total, F.col("amount")))))
    none = report.sparkSession.range(1).select(F.inline(F.array(entry(True, total, F.lit(None)))))
    groups = (
        entries.unionByName(none)
        .groupBy("_is_total", *names)
        .agg(F.count(F.lit(1)).alias("_rows"), F.sum("_part").cast("double").alias("_sum"))
    )
    copies = F.when(F.col("_is_total"), 1).otherwise(F.col("_rows")).cast("int")
    return (
        groups.withColumn("amount", F.when(F.col("_is_total"), F.col("_sum")).otherwise(F.col("amount")))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies)))
        .select(*names)
    )


def grand_total(report: DataFrame) -> DataFrame:
    """The report's total amount as one row of the report."""
    total = report.agg(money_sum("amount").alias("amount")).withColumn("department", F.lit("Total"))
    return total.select(
        *[
            F.col(f.name) if f.name in ("amount", "department") else F.lit(None).cast(f.dataType).alias(f.name)
            for f in REVENUE.fields
        ]
    )
