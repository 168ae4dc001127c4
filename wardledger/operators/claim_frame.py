"""What the claim operators share: a claim's appointments, visits and stay.

A job that runs several operators keeps them: each is then computed and written once, bucketed by claim (billed visits
by encounter), so the operators that read them join and group without moving them again. A single operator keeps only
what it reads several times. A table is built when it is first asked for. A claim's rows are
narrow here (ids, dates, numbers) and are streamed; a claim with very many visits makes its bucket longer, not larger
in memory.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.functions.columns import clock, differs, is_blank, is_unset
from wardledger.functions.joins import dealt_by, spread_null
from wardledger.operators.claim_header import listed_appointments, own_visits
from wardledger.session import Workspace, together
from wardledger.sources.tables import Tables


ALL = ("claims", "appointments", "visits", "stays", "billed")
#: What the lines read of a claim and of its appointments: of all, of its own one, of the listed ones; and what headers read of its own.
LINE_CLAIM = ["name", "company", "patient_appointment", "claim_appointment_list"]
LINE_DETAILS = ["billing_item", "practitioner"]
OWN_DETAILS = ["paid_amount", "creation"]
LISTED_DETAILS = ["claim_company", "modified", "insurance_subscription", "insurance_company"]
HEADER_DETAILS = [
    "patient", "company", "coverage_plan_card_number", "authorization_number", "coverage_plan_name", "appointment_date", "appointment_time",
]


def chargeable() -> Column:
    """Whether an appointment's consultation is charged."""
    return is_unset("follow_up") & differs("has_no_consultation_charges", 1)


class ClaimFrame:
    def __init__(self, claims: DataFrame, t: Tables, keep: tuple[str, ...] = ALL, lines_only: bool = False):
        """``lines_only`` frames hold what claim lines read, and nothing that only headers and notes do."""
        self.lines_only = lines_only
        claims = claims.select(*LINE_CLAIM) if lines_only else claims
        self.given, self.t, self.kept, self.space = claims, t, keep, Workspace(claims.sparkSession, "zstd")

    def _keep(self, df: DataFrame, name: str, by: str) -> DataFrame:
        return self.space.keep(df, name, by=(by,)) if name in self.kept else df

    def prepare(self) -> None:
        """Builds the kept tables, those that don't need each other at the same time."""
        _ = self.claims
        together(lambda: self.appointments, lambda: self.visits)
        _ = self.stays

    @cached_property
    def claims(self) -> DataFrame:
        """The given claims, read once."""
        return self._keep(self.given, "claims", "name")

    @cached_property
    def appointments(self) -> DataFrame:
        """A row per claim and appointment that exists: ``position`` in its list, and -1 for the claim's own one.

        Listed ones are there if they are chargeable; a row holds what its position is read for, and NULL else.
        """
        own = F.array(F.struct(F.lit(-1).alias("position"), F.col("patient_appointment").alias("appointment")))
        listed = F.transform(listed_appointments(), lambda a, i: F.struct(i.cast("int").alias("position"), a.alias("appointment")))
        named = self.claims.select(
            F.col("name").alias("claim"), F.col("company").alias("claim_company"), F.inline(F.concat(own, listed))
        ).filter(~is_blank("appointment"))
        own_details = OWN_DETAILS if self.lines_only else [*OWN_DETAILS, *HEADER_DETAILS]
        details = self.t.patient_appointment.select(
            F.col("name").alias("appointment"), *LINE_DETAILS, *own_details, *LISTED_DETAILS[1:], chargeable().alias("_chargeable")
        )
        is_own = F.col("position") == -1
        found = named.join(details, "appointment").filter(is_own | F.col("_chargeable")).select(
            "claim", "position", "appointment", *LINE_DETAILS,
            *[F.when(is_own, F.col(c)).alias(c) for c in own_details],
            *[F.when(~is_own, F.col(c)).alias(c) for c in LISTED_DETAILS],
        )
        return self._keep(found, "appointments", "claim")

    @cached_property
    def visits(self) -> DataFrame:
        """A row per claim and submitted encounter; only final ones that name an inpatient record hold it and ``modified``."""
        encounters = self.t.patient_encounter.filter(F.col("docstatus") == 1).select(*own_visits(), "inpatient_record")
        recorded = F.col("is_final") & (F.col("inpatient_record") != "")
        encounters = encounters.withColumns({c: F.when(recorded, F.col(c)) for c in ("modified", "inpatient_record")})
        wanted = self.claims.select(
            F.col("name").alias("claim"),
            F.col("company").alias("claim_company"),
            F.col("patient_appointment").alias("claim_appointment"),
            F.explode(F.array_distinct(listed_appointments())).alias("appointment"),
        ).filter(~is_blank("appointment"))
        return self._keep(wanted.join(encounters, "appointment").drop("appointment"), "visits", "claim")

    def with_people(self, encounters: DataFrame) -> DataFrame:
        """Adds what is known of the practitioner; one that is stored twice gives its encounters twice."""
        people = self.t.healthcare_practitioner.select(
            F.col("name").alias("_who"), F.lit(True).alias("known"), "practitioner_name", "tz_mct_code", "department"
        )
        return encounters.withColumn("_who", spread_null("practitioner", "encounter")).join(people, "_who", "left").drop("_who")

    @property
    def finals(self) -> DataFrame:
        return self.visits.filter("is_final")

    @cached_property
    def stays(self) -> DataFrame:
        """A row per claim with an inpatient record: the record, its admission, and the days with a bed.

        ``days`` leads from a check-in day to the first occupancy of that day: its number and its service unit. It has
        an entry per calendar day of the stay.
        """
        records = (
            self.finals.filter(F.col("inpatient_record") != "")
            .groupBy("claim")
            .agg(
                F.max_by("inpatient_record", F.struct("modified", "encounter")).alias("inpatient_record"),
                F.first("claim_company").alias("company"),
                F.first("claim_appointment").alias("patient_appointment"),
            )
        )
        day = F.to_date("check_in")
        days = (
            dealt_by(self.t.inpatient_occupancy.filter(day.isNotNull() & F.col("parent").isNotNull()), "parent")
            .groupBy(F.col("parent").alias("inpatient_record"), day.alias("day"))
            .agg(F.min(F.struct(F.col("idx").alias("position"), "name", "service_unit")).alias("first"))
            .groupBy("inpatient_record")
            .agg(F.map_from_entries(F.collect_list(F.struct("day", "first"))).alias("days"))
        )
        details = self.t.inpatient_record.select(
            F.col("name").alias("inpatient_record"),
            F.lit(True).alias("recorded"),
            "admission_encounter",
            "discharge_date",
            "scheduled_date",
            F.to_date("admitted_datetime").alias("admitted_day"),
            clock("admitted_datetime").alias("admitted_clock"),
            clock("creation").alias("created_clock"),
        )
        found = records.join(details, "inpatient_record", "left").join(days, "inpatient_record", "left")
        return self._keep(found, "stays", "claim")

    @cached_property
    def billed(self) -> DataFrame:
        """The encounters a claim bills, bucketed by encounter; of an inpatient claim those on a day with a bed."""
        inpatient = F.col("inpatient_record").isNotNull()
        days = self.stays.select("claim", "inpatient_record", "days")
        found = (
            self.visits.drop("inpatient_record")
            .join(days, "claim", "left")
            .withColumn("position", F.try_element_at("days", F.col("encounter_date"))["position"])
            .filter(~inpatient | F.col("position").isNotNull())
            .select(
                "claim", "encounter", "creation", "practitioner", inpatient.alias("inpatient"),
                F.coalesce("position", F.lit(0)).alias("position"),
            )
        )
        return self._keep(found, "billed", "encounter")
