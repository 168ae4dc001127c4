"""Jobs that change stored tables: each publishes one version, once, however often it is run under its name."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import differs
from wardledger.functions.joins import join_null_safe
from wardledger.operators import claim_header as H
from wardledger.operators import claim_reconcile as M
from wardledger.operators import delivery as L
from wardledger.operators import stock as S
from wardledger.sources.schemas import STOCK_STATE, shaped
from wardledger.sources.tables import Tables
from wardledger.sources.versions import VersionedTable


def save_appointment_links(appointments: VersionedTable, claims: DataFrame, run: str) -> int:
    """Renews the appointments' links to these claims; only appointments whose link changes are written."""
    base = appointments.version()
    return appointments.upsert(_changed_links(appointments.read(base), claims, H.link_appointments), ["name"], run, base)


def save_deleted_claims(appointments: VersionedTable, deleted: DataFrame, run: str) -> int:
    """Clears the links of the deleted claims' own appointments."""
    base = appointments.version()
    return appointments.upsert(_changed_links(appointments.read(base), deleted, H.unlink_deleted_claims), ["name"], run, base)


def _changed_links(appointments: DataFrame, claims: DataFrame, link) -> DataFrame:
    before = appointments.withColumn("_before", F.col("nhif_patient_claim"))
    return link(before, claims).filter(differs("nhif_patient_claim", F.col("_before"))).drop("_before")


def save_folio_counters(counters: VersionedTable, headers: DataFrame, run: str) -> int:
    """The counters after these new claims were numbered."""
    base = counters.version()
    stored = counters.read(base)
    touched = stored.join(headers.select(*H.FOLIO_KEYS).distinct(), H.FOLIO_KEYS, "left_semi")
    new = shaped(H.folio_counters(headers, touched), counters.schema, missing_as_null=True)
    return counters.upsert(new, H.FOLIO_KEYS, run, base)


def save_original_snapshot(originals: VersionedTable, items: DataFrame, run: str) -> int:
    """The items of new claims as their originals."""
    return originals.append(shaped(M.original_snapshot(items), originals.schema, missing_as_null=True), run)


def save_missing_originals(originals: VersionedTable, items: DataFrame, run: str, token_match: bool = False) -> int:
    """Adds the claim items that no original names."""
    base = originals.version()
    missing = M.missing_originals(items, originals.read(base), token_match)
    return originals.append(shaped(missing, originals.schema, missing_as_null=True), run, base)


def save_dispensed_drugs(prescriptions: VersionedTable, t: Tables, run: str) -> int:
    """The drug prescriptions after the delivery notes: dispensed rows added, undelivered ones gone."""
    base = prescriptions.version()
    return prescriptions.replace(L.updated_prescriptions(t.with_tables(drug_prescription=prescriptions.read(base))), run, base)


def save_stock_state(state: VersionedTable, t: Tables, run: str, lag: dt.timedelta = dt.timedelta(hours=1)) -> int:
    """Brings the kept stock state (``STOCK_STATE``) up to the ledger; S6 is then ``stock_of_state`` of it.

    Only entries made since the last one the state has seen are read, and those of ``lag`` before it, since entries
    become visible in another order than they are made; entries without a time are read each time. A cancellation marks
    earlier entries and adds entries that are cancelled themselves: items and warehouses with such an entry among those
    read are computed anew from the whole ledger, the others are merged. Only keys whose state changes are written.
    """
    base = state.version()
    stored = state.read(base)
    ledger = t.stock_ledger_entry
    mark = stored.agg(F.max("seen")).first()[0]
    recent = ledger if mark is None else ledger.filter(F.col("creation").isNull() | (F.col("creation") >= F.lit(mark - lag)))
    if mark is None:
        return state.upsert(S.stock_state(recent), S.STOCK_KEYS, run, base)
    cancelled = recent.filter(~F.col("is_cancelled").eqNullSafe(0)).select(*S.STOCK_KEYS).distinct()
    touched = recent.select(*S.STOCK_KEYS).distinct()
    kept = join_null_safe(stored, touched, S.STOCK_KEYS, "left_semi")
    merged = S.merged_stock_state(kept, S.stock_state(recent))
    if not cancelled.isEmpty():
        anew = S.stock_state(join_null_safe(ledger, cancelled, S.STOCK_KEYS, "left_semi"))
        merged = join_null_safe(merged, cancelled, S.STOCK_KEYS, "left_anti").unionByName(anew)
    changed = merged.exceptAll(kept)
    return state.upsert(changed, S.STOCK_KEYS, run, base)
