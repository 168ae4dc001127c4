"""Building claims in bulk: header, diseases, lines, totals, notes, folio numbers, documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardledger.operators import claim_changes as G
from wardledger.operators import claim_checks as V
from wardledger.operators import claim_header as H
from wardledger.operators import claim_items as C
from wardledger.operators.claim_diseases import claim_diseases
from wardledger.operators.claim_export import folio_documents
from wardledger.operators.claim_frame import ClaimFrame
from wardledger.operators.claim_notes import clinical_notes
from wardledger.operators.claim_reconcile import mergeable_claims, reconcile_items
from wardledger.options import RunContext
from wardledger.session import materialize, together
from wardledger.sources.tables import Tables


@dataclass(frozen=True)
class BuiltClaims:
    headers: DataFrame
    diseases: DataFrame
    lines: DataFrame
    notes: DataFrame
    folio_numbers: DataFrame
    folio_counters: DataFrame
    run: RunContext

    @property
    def totals(self) -> DataFrame:
        return C.claim_totals(self.lines.withColumnRenamed("claim", "parent"))

    @property
    def saved_headers(self) -> DataFrame:
        """Headers as they are saved: with their folio number, notes and the total of their lines, 0 without lines."""
        return (
            self.headers.join(self.totals.withColumnRenamed("claim", "name"), "name", "left")
            .join(self.folio_numbers.select(F.col("claim").alias("name"), "folio_no"), "name", "left")
            .join(self.notes.withColumnRenamed("claim", "name"), "name", "left")
            .withColumn("total_amount", F.coalesce("total_amount", F.lit(0.0)))
        )

    @property
    def saved_diseases(self) -> DataFrame:
        return C.completed_diseases(self.diseases, self.headers, self.run)

    @property
    def documents(self) -> DataFrame:
        return folio_documents(self.headers, self.diseases, self.lines, self.notes, self.folio_numbers)


def build_claims(claims: DataFrame, t: Tables, run: RunContext) -> BuiltClaims:
    """Everything that saving a claim computes, for all the given claims.

    The claims meet their appointments, encounters and stays once (``ClaimFrame``); headers are kept too, bucketed by
    claim, since several outputs read them.
    """
    frame = ClaimFrame(claims, t)
    frame.prepare()

    def heads() -> tuple[DataFrame, DataFrame, DataFrame]:
        headers = H.finished_headers(materialize(H.known_headers_of(frame, run), ("name",), "zstd"), run)
        return headers, *H.folio_numbers(headers, t.folio_counter, stored=True)

    (headers, numbers, counters), lines = together(heads, lambda: C.claim_lines_of(frame))
    return BuiltClaims(
        headers=headers,
        diseases=claim_diseases(claims, t, frame.visits),
        lines=lines,
        notes=clinical_notes(frame, headers, run),
        folio_numbers=numbers,
        folio_counters=counters,
        run=run,
    )


def merge_leads(claims: DataFrame) -> DataFrame:
    """The claims that lead a merge, with the appointments of all claims of their group as their list."""
    merged = mergeable_claims(claims).select(F.col("claim").alias("name"), F.col("claim_appointment_list").alias("_merged"))
    return claims.join(merged, "name").withColumn("claim_appointment_list", F.col("_merged")).select(*claims.columns)


def rebuild_merged_claims(claims: DataFrame, t: Tables, run: RunContext) -> BuiltClaims:
    """Merged claims built anew from the united appointments, as saving them does.

    They keep their folio numbers' order among themselves; the claims that were merged into them stay as they are.
    """
    return build_claims(materialize(merge_leads(claims)), t, run)


def submit_claims(claims: DataFrame, t: Tables, run: RunContext) -> tuple[DataFrame, DataFrame]:
    """(violations, change records) of saved claims at submission.

    Changes are tracked for the claims that are submitted (``docstatus`` 1), after their originals
    were reconciled.
    """
    violations = V.claim_violations(claims, t.claim_item, t, run)
    submitted = claims.filter(F.col("docstatus") == 1).select(F.col("name").alias("parent"))
    originals = materialize(
        reconcile_items(t.original_claim_item.join(submitted, "parent", "left_semi"))
    )
    items = t.claim_item.join(submitted, "parent", "left_semi")
    return violations, G.track_changes(originals, items, H.claim_periods(claims, t, run), t, run)
