"""The combined hospital revenue report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardledger.operators import revenue as R
from wardledger.options import ReportFilters
from wardledger.sources.tables import Tables


def revenue_report(t: Tables, filters: ReportFilters, include_cash: bool = False) -> DataFrame:
    """All revenue sources as one bag of rows.

    The prescription kinds are united before their encounter join, once for the documented and once for
    the other kinds, and share one aggregation. All three filters are needed, because the inpatient
    sources cannot run without them.
    """
    report = (
        R.consultation_revenue(t, filters)
        .unionByName(R.prescription_revenue(t, filters))
        .unionByName(R.bed_revenue(t, filters))
        .unionByName(R.consultancy_revenue(t, filters))
    )
    if include_cash:
        report = report.unionByName(R.cash_revenue(t, filters))
    return report


def report_with_total(report: DataFrame) -> DataFrame:
    """The report and its total row, computed in one pass."""
    return R.with_grand_total(report)
