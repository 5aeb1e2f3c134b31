"""Calendar expressions (all DateType, all built-in)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def half_year_end(d) -> Column:
    """30 Jun for Jan..Jun, 31 Dec for Jul..Dec of the same year."""
    d = as_col(d)
    return F.when(F.month(d) <= 6, F.make_date(F.year(d), F.lit(6), F.lit(30))) \
            .otherwise(F.make_date(F.year(d), F.lit(12), F.lit(31)))


def quarter_end(d) -> Column:
    d = as_col(d)
    return F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1)))


def month_end(d) -> Column:
    return F.last_day(as_col(d))


def snap_report_date(d) -> Column:
    """Reporting-date snap: May/Jun -> 30 Jun, Nov/Dec -> 31 Dec, else as is."""
    d = as_col(d)
    m = F.month(d)
    return (F.when(m.isin(5, 6), F.make_date(F.year(d), F.lit(6), F.lit(30)))
             .when(m.isin(11, 12), F.make_date(F.year(d), F.lit(12), F.lit(31)))
             .otherwise(d))


def months_back_to_month_end(d, months: int) -> Column:
    """Shift back ``months`` and land on that month's last day."""
    return F.last_day(F.add_months(as_col(d), -months))


def date_flag(d, start: str, end: str) -> Column:
    """1 when start <= d <= end (inclusive), else 0."""
    d = as_col(d)
    return F.when(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")), 1).otherwise(0)
