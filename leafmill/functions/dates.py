"""Dates of the info dictionary: D:YYYYMMDDHHmmSS, read leniently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _field(text: Column, start: int, size: int, default: int) -> Column:
    """A whole number at the start of the field; 0, or none, is the default."""
    part = F.substring(text, start, size)
    number = F.when(part.rlike(r"^[0-9]+$"), part.try_cast("int")).otherwise(F.regexp_extract(part, r"^\s*([+-]?\d+)", 1).try_cast("int"))
    return F.coalesce(F.nullif(number, F.lit(0)), F.lit(default))


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def pdf_date(value: Column) -> Column:
    """The timestamp of a date; fields out of range roll over, years 0 to 99 are 1900 and on, the offset is ignored.

    Null and texts without a year that a timestamp can have give null; an empty text is the first day of 1900.
    """

    def moved(f: Column) -> Column:
        year = F.when(f[0].between(0, 99), f[0] + 1900).otherwise(f[0])
        start = F.try_make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        return start + F.make_interval(F.lit(0), f[1] - 1, F.lit(0), f[2] - 1, f[3], f[4], f[5])

    def fields(text: Column) -> Column:
        return F.array(_field(text, 1, 4, 0), *(_field(text, a, 2, d) for a, d in ((5, 1), (7, 1), (9, 0), (11, 0), (13, 0))))

    text = F.when(value.startswith("D:"), F.substring(value, 3, 1_000)).otherwise(value)
    return F.when(value.isNotNull(), _bound(_bound(text, fields), moved))
