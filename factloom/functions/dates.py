"""Times and dates as the claims carry them: the literal stays, a typed value goes beside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the accepted profile of RFC 3339: upper-case T and Z, at most six fractional digits, a known offset.
RFC3339 = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def timestamp(value: Column) -> Column:
    """The instant of an RFC 3339 literal, null outside the profile; an unknown offset (-00:00) is outside."""
    return F.when(value.rlike(RFC3339) & ~value.endswith("-00:00"), F.try_to_timestamp(value))


def not_after(value: Column, cutoff: Column) -> Column:
    """Whether a date literal or an instant literal is not after the cutoff instant."""
    return F.coalesce(timestamp(value) <= cutoff, F.try_to_date(value, "yyyy-MM-dd") <= cutoff.cast("date"), F.lit(False))


def period_ok(start: Column, end: Column) -> Column:
    """A period of two dates in order."""
    a, b = (F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")) for c in (start, end))
    return F.coalesce(a <= b, F.lit(False))


def displayed_date(text: Column) -> Column:
    """The date of a displayed text: ISO, day.month.year, or an English day month year."""
    return F.coalesce(F.try_to_date(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(text, r"(\d{2}\.\d{2}\.\d{4})", 1), "dd.MM.yyyy"), F.try_to_date(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]+ \d{4})", 1), "d MMMM yyyy"))
