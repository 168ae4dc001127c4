"""Job parameters. Nothing in the library reads the clock, so a retried job gives the same rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReportFilters:
    """Revenue report filters; each is optional except where an operator says otherwise."""

    from_date: dt.date | None = None
    to_date: dt.date | None = None
    company: str | None = None

    def date_range(self, column: str) -> Column:
        """Inclusive range on the raw column, so that it reaches the parquet scan."""
        cond = F.lit(True)
        if self.from_date:
            cond = cond & (F.col(column) >= F.lit(self.from_date))
        if self.to_date:
            cond = cond & (F.col(column) <= F.lit(self.to_date))
        return cond

    def instant_range(self, column: str) -> Column:
        """Inclusive day range on a datetime column without wrapping the column in a cast."""
        cond = F.lit(True)
        if self.from_date:
            cond = cond & (F.col(column) >= F.lit(self.from_date).cast("timestamp_ntz"))
        if self.to_date:
            after = self.to_date + dt.timedelta(days=1)
            cond = cond & (F.col(column) < F.lit(after).cast("timestamp_ntz"))
        return cond

    def same_company(self, column: str = "company") -> Column:
        return F.col(column) == F.lit(self.company) if self.company else F.lit(True)

    def require_all(self, operator: str) -> None:
        if not (self.from_date and self.to_date and self.company):
            raise ValueError(f"{operator} needs from_date, to_date and company")


@dataclass(frozen=True)
class RunContext:
    """The run's date and time and its user; they stand for "now" and "me" in every job."""

    as_of: dt.datetime
    user_email: str = "batch@example.org"
    user_name: str = "Batch"

    @property
    def today(self) -> Column:
        return F.lit(self.as_of.date())

    @property
    def time_text(self) -> Column:
        return F.lit(self.as_of.strftime("%H:%M:%S"))
