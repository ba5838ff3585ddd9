"""Date parsing and period keys (DAT1, DAT2, ENC3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-digit years at or above this pivot belong to the 1900s
# (Python ``%y``); Spark alone would put every ``yy`` in 2000-2099.
TWO_DIGIT_YEAR_PIVOT = 69


def parse_day_mon_yy(col: Column | str) -> Column:
    """DAT1: ``dd-MMM-yy`` (``05-Jan-85``) -> date with the Python century rule."""
    c = F.col(col) if isinstance(col, str) else col
    d = F.to_date(c, "dd-MMM-yy")
    return F.when(F.year(d) >= 2000 + TWO_DIGIT_YEAR_PIVOT, F.add_months(d, -1200)).otherwise(d)


def format_day_mon_yy(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "dd-MMM-yy")


def month_key(col: Column | str) -> Column:
    """DAT2: first day of the month as a DATE."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trunc(F.to_date(c), "month")


def month_label(col: Column | str) -> Column:
    """DAT2: ``Jan-2020`` label."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "MMM-yyyy")


def days_since_epoch(col: Column | str) -> Column:
    """ENC3: a date as a numeric feature (days since 1970-01-01)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
