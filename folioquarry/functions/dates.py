"""Dates as documents write them. The text is kept; the day is a column beside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in order; a day before a month where both could be.
FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy", "d.M.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd")


def day(text: Column) -> Column:
    """The day that a text names in one of the known formats, or null."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in FORMATS])


def fiscal_year(d: Column, first_month: int = 7) -> Column:
    """The year in which a fiscal year that begins on the first of ``first_month`` ends."""
    return F.year(F.add_months(d, 12 - first_month + 1 if first_month > 1 else 0))
