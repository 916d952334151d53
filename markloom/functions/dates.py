"""Dates that arrive in many spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# spellings tried in this order (day before month)
FORMATS = ["dd/MM/yyyy", "d/M/yyyy", "yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "d-M-yyyy"]


def parse_date(text: Column, formats: list[str] | None = None) -> Column:
    """The first spelling that fits, after dropping ordinal endings (3rd, 21st); null if none."""
    plain = F.trim(F.regexp_replace(text, r"(?<=\d)(st|nd|rd|th)", ""))
    tries = [F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in (formats or FORMATS)]
    return F.coalesce(*tries)


def to_day_text(text: Column) -> Column:
    return F.date_format(parse_date(text), "dd/MM/yyyy")


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", day))
