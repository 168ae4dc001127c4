"""Stock on hand and the checks of orders and invoices against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import is_blank
from wardledger.functions.joins import dealt_by, join_frequent
from wardledger.operators.prescriptions import DRUG
from wardledger.sources.tables import Tables

# Document stages that check stock; the first one only warns.
SEVERITY = {"validate": "warn", "before_submit": "error"}


def stock_on_hand(t: Tables) -> DataFrame:
    """Quantity after the latest ledger entry of each item and warehouse that is not cancelled."""
    return (
        t.stock_ledger_entry.filter(F.col("is_cancelled") == 0)
        .groupBy("item_code", "warehouse")
        .agg(F.max_by("qty_after_transaction", F.struct("creation", "name")).alias("_qty"))
        .select("item_code", "warehouse", F.coalesce("_qty", F.lit(0.0)).alias("actual_qty"))
    )


STOCK_KEYS = ["item_code", "warehouse"]


def stock_state(entries: DataFrame) -> DataFrame:
    """The latest entry that is not cancelled of each item and warehouse, and when its last entry of any kind was made.

    ``stock_on_hand`` kept in a form that later entries can be merged with; keys with cancelled entries only have no ``entry``.
    """
    latest = F.struct("creation", "name", "qty_after_transaction")
    grouped = entries.groupBy(*STOCK_KEYS).agg(
        F.max(F.when(F.col("is_cancelled") == 0, latest)).alias("_latest"), F.max("creation").alias("seen")
    )
    return _state_columns(grouped)


def _state_columns(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        *STOCK_KEYS,
        F.col("_latest.creation").alias("entry_creation"),
        F.col("_latest.name").alias("entry"),
        F.col("_latest.qty_after_transaction").alias("qty_after_transaction"),
        F.col("_latest").isNotNull().alias("has_entry"),
        "seen",
    )


def merged_stock_state(state: DataFrame, more: DataFrame) -> DataFrame:
    """The state after the entries that ``more`` is the state of; an entry may be in both."""
    entry = F.struct(F.col("entry_creation").alias("creation"), F.col("entry").alias("name"), "qty_after_transaction")
    grouped = state.unionByName(more).groupBy(*STOCK_KEYS).agg(
        F.max(F.when(F.col("has_entry"), entry)).alias("_latest"), F.max("seen").alias("seen")
    )
    return _state_columns(grouped)


def stock_of_state(state: DataFrame) -> DataFrame:
    """``stock_on_hand`` from the kept state."""
    return state.filter("has_entry").select(*STOCK_KEYS, F.coalesce("qty_after_transaction", F.lit(0.0)).alias("actual_qty"))


def _checked(items: DataFrame, lines: DataFrame, t: Tables, stage: str) -> DataFrame:
    """Shortages of stock items and, when validating, drug lines that are no stock item.

    An item that many of the ``lines``, from which ``items`` come, name does not pile up on one task.
    """
    kinds = t.item.select("item_code", "is_stock_item")
    is_stock = F.coalesce(F.col("is_stock_item") == 1, F.lit(False))
    available = F.coalesce("actual_qty", F.lit(0.0))
    rule = F.when(is_stock & (F.col("qty") > available), "shortage")
    if stage == "validate":
        rule = rule.when(~is_stock & (F.col("reference_dt") == DRUG), "not_a_stock_item")
    row = F.concat_ws("/", "parent", "idx")
    with_kind = join_frequent(items, kinds, ["item_code"], row, "left", lines)
    return (
        join_frequent(with_kind, stock_on_hand(t), STOCK_KEYS, row, "left", lines, ["item_code"])
        .withColumn("rule", rule)
        .filter(F.col("rule").isNotNull())
        .select(
            "parent",
            "idx",
            "item_code",
            "warehouse",
            "rule",
            F.lit(SEVERITY[stage]).alias("severity"),
            "qty",
            F.when(is_stock, available).alias("available"),
        )
    )


def order_stock_checks(t: Tables, stage: str) -> DataFrame:
    """Order items against the order's warehouse."""
    orders = t.sales_order.select(F.col("name").alias("parent"), F.col("set_warehouse").alias("warehouse"))
    items = t.sales_order_item.select("parent", "idx", "item_code", "qty", "reference_dt")
    return _checked(items.join(orders, "parent"), t.sales_order_item, t, stage)


def _first_items(t: Tables) -> DataFrame:
    """(parent, sales_order, reference_dt) of each invoice's first item."""
    return (
        dealt_by(t.sales_invoice_item, "parent").groupBy("parent")
        .agg(F.min(F.struct("idx", "name", "sales_order", "reference_dt")).alias("first"))
        .select("parent", "first.sales_order", F.col("first.reference_dt").alias("first_dt"))
    )


def invoice_stock_checks(t: Tables, stage: str) -> DataFrame:
    """Invoice items against the row's warehouse.

    Invoices without automatic delivery notes are left out; validating looks only at invoices whose
    first item comes from a sales order for a drug prescription.
    """
    invoices = t.sales_invoice.filter(
        ~F.col("enabled_auto_create_delivery_notes").eqNullSafe(0)
    ).select(F.col("name").alias("parent"))
    if stage == "validate":
        firsts = _first_items(t).filter(~is_blank("sales_order") & (F.col("first_dt") == DRUG))
        invoices = invoices.join(firsts.select("parent"), "parent")
    items = t.sales_invoice_item.select("parent", "idx", "item_code", "qty", "reference_dt", "warehouse")
    return _checked(items.join(invoices, "parent"), t.sales_invoice_item, t, stage)


def with_order_dimensions(t: Tables) -> DataFrame:
    """Invoice items with empty practitioner, unit and department taken from the first item's order."""
    dimensions = ["healthcare_practitioner", "healthcare_service_unit", "department"]
    orders = t.sales_order.select(F.col("name").alias("_order"), *[F.col(d).alias(f"_{d}") for d in dimensions])
    firsts = (
        _first_items(t)
        .filter(~is_blank("sales_order"))
        .select("parent", F.col("sales_order").alias("_order"))
        .join(orders, "_order")
        .drop("_order")
    )
    items = dealt_by(t.sales_invoice_item, "parent")
    filled = {
        d: F.when(is_blank(d) & F.col("_from_order"), F.col(f"_{d}")).otherwise(F.col(d)) for d in dimensions
    }
    return (
        items.join(firsts.withColumn("_from_order", F.lit(True)), "parent", "left")
        .withColumn("_from_order", F.coalesce("_from_order", F.lit(False)))
        .withColumns(filled)
        .select(*items.columns)
    )


def with_invoice_dosage(t: Tables) -> DataFrame:
    """Delivery items whose description names no frequency take the invoice item's dosage text; only these move."""
    items = t.delivery_note_item
    wants = ~F.coalesce("description", F.lit("")).contains("frequency") & ~is_blank("si_detail")
    dosages = t.sales_invoice_item.select(F.col("name").alias("si_detail"), F.col("dosage_info").alias("_dosage"))
    filled = items.filter(wants).drop("description").join(dosages, "si_detail", "left").withColumnRenamed("_dosage", "description")
    return items.filter(~wants).unionByName(filled.select(*items.columns))
