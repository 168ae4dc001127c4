"""Sales orders from encounters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import is_blank, non_blank, stable_id
from wardledger.functions.joins import join_frequent, spread_null
from wardledger.operators.prescriptions import DRUG, LAB, prescriptions, with_item
from wardledger.options import RunContext
from wardledger.sources.tables import Tables

# Dosage text of a drug line: label, source column, text where it is missing.
DOSAGE_PARTS = (
    ("frequency", "dosage", "No Prescription Dosage"),
    ("period", "period", "No Prescription Period"),
    ("dosage_form", "dosage_form", ""),
    ("interval", "interval", ""),
    ("interval_uom", "interval_uom", ""),
    ("medical_code", "medical_code", "No medical code"),
    ("Doctor's comment", "comment", "Take medication as per dosage."),
)
# Fixed value: blank dosage text of a stock item.
DOSAGE_TEMPLATE = (
    "frequency: , \nperiod: , \ndosage_form: , \ninterval: , \ninterval_uom: , \nDoctor's comment: "
)


def order_encounters(t: Tables) -> DataFrame:
    """Submitted encounters that give orders: outpatients, and insured inpatients."""
    return t.patient_encounter.filter(
        (F.col("docstatus") == 1) & (is_blank("inpatient_record") | ~is_blank("insurance_subscription"))
    )


def dosage_text() -> Column:
    parts = [
        F.concat(F.lit(f"{label}: "), F.coalesce(non_blank(column), F.lit(missing)))
        for label, column, missing in DOSAGE_PARTS
    ]
    return F.concat_ws(", <br>", *parts)


def order_lines(encounters: DataFrame, t: Tables, run: RunContext) -> DataFrame:
    """Lines of the encounters' prescriptions that are to be sold."""
    rows = prescriptions(t).filter(
        ~F.col("prescribe").eqNullSafe(0)
        & ~F.col("is_not_available_inhouse").eqNullSafe(1)
        & ~F.col("is_cancelled").eqNullSafe(1)
    )
    visits = encounters.select(F.col("name").alias("parent"), "company").join(
        t.company_warehouse, "company", "left"
    )
    items = t.item.select(F.col("item_code").alias("_item"), "item_name", "description")
    is_drug = F.col("ref_doctype") == DRUG
    sold = with_item(rows.join(visits, "parent"), t).withColumn("_item", spread_null("item_code", "name"))
    return (
        join_frequent(sold, items, ["_item"], "name", "left")
        .select(
            F.col("parent").alias("encounter"),
            F.when(is_drug, "drug").when(F.col("ref_doctype") == LAB, "lab").otherwise("other").alias("category"),
            "item_code",
            "item_name",
            "description",
            F.when(is_drug, F.col("quantity") - F.col("quantity_returned")).otherwise(1.0).alias("qty"),
            run.today.alias("delivery_date"),
            "warehouse",
            F.col("ref_doctype").alias("reference_dt"),
            F.col("name").alias("reference_dn"),
            F.when(is_drug, dosage_text()).alias("dosage_info"),
        )
    )


def _priced_encounters(encounters: DataFrame, t: Tables) -> DataFrame:
    """Encounters with the warehouse and price list their orders use."""
    modes = t.mode_of_payment.select(F.col("name").alias("mode_of_payment"), F.col("price_list").alias("_mode_list"))
    companies = t.company.select(F.col("name").alias("company"), "default_price_list")
    return (
        encounters.join(t.company_warehouse, "company", "left")
        .join(modes, "mode_of_payment", "left")
        .join(companies, "company", "left")
        .withColumn("price_list", F.coalesce(non_blank("_mode_list"), non_blank("default_price_list")))
        .withColumn("encounter", F.col("name"))
    )


def order_headers(encounters: DataFrame, lines: DataFrame, t: Tables, run: RunContext) -> DataFrame:
    """One order per encounter and category that has lines."""
    wanted = lines.select("encounter", "category").distinct()
    ready = _priced_encounters(encounters, t).filter(
        F.col("warehouse").isNotNull() & F.col("price_list").isNotNull()
    )
    patients = t.patient.select(F.col("name").alias("patient"), "customer", F.col("mobile").alias("patient_mobile_number"))
    return (
        wanted.join(ready, "encounter")
        .join(patients, "patient", "left")
        .select(
            stable_id("encounter", "category").alias("name"),
            "encounter",
            "category",
            "company",
            "customer",
            "patient",
            "patient_name",
            "patient_mobile_number",
            run.today.alias("transaction_date"),
            run.today.alias("delivery_date"),
            "price_list",
            F.col("warehouse").alias("set_warehouse"),
            "healthcare_service_unit",
            F.col("practitioner").alias("healthcare_practitioner"),
        )
    )


def order_violations(encounters: DataFrame, lines: DataFrame, t: Tables) -> DataFrame:
    """Encounters of a company without a warehouse, or with lines but no price list."""
    priced = _priced_encounters(encounters, t)
    no_warehouse = priced.filter(F.col("warehouse").isNull()).select(
        "encounter", F.lit("unknown_warehouse").alias("rule"), F.col("company").alias("detail")
    )
    with_lines = lines.select("encounter").distinct()
    no_list = (
        priced.filter(F.col("warehouse").isNotNull() & F.col("price_list").isNull())
        .join(with_lines, "encounter", "left_semi")
        .select("encounter", F.lit("no_price_list").alias("rule"), F.col("mode_of_payment").alias("detail"))
    )
    return no_warehouse.unionByName(no_list)


def with_dosage_template(items: DataFrame, t: Tables) -> DataFrame:
    """Order items in which stock items refer to a drug prescription and have a dosage text."""
    stock = t.item.select("item_code", "is_stock_item")
    is_stock = F.coalesce(F.col("is_stock_item") == 1, F.lit(False))
    return (
        items.join(stock, "item_code", "left")
        .withColumn("reference_dt", F.when(is_stock, F.lit(DRUG)).otherwise(F.col("reference_dt")))
        .withColumn(
            "dosage_info",
            F.when(is_stock, F.coalesce(non_blank("dosage_info"), F.lit(DOSAGE_TEMPLATE))).otherwise(F.col("dosage_info")),
        )
        .select(*items.columns)
    )
