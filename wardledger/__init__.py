"""Hospital revenue and insurance-claim analytics as Spark DataFrame jobs."""

from wardledger.options import ReportFilters, RunContext
from wardledger.sources.tables import Tables

__all__ = ["ReportFilters", "RunContext", "Tables"]
