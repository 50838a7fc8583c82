"""Date and time helpers. Timestamps are instants; what is printed is UTC in any session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)$"


def strict_instant(s: Column) -> Column:
    """An RFC 3339 text as a timestamp, else null."""
    zoned = F.regexp_replace(s, r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(s.rlike(RFC3339), F.try_to_timestamp(zoned))


def lenient_instant(s: Column) -> Column:
    """An RFC 3339 text or a date; null, empty and junk are null."""
    date = F.when(s.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    return F.coalesce(strict_instant(s), date)


def in_window(due: Column, assigned: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Dated rows by their date, both ends included; undated ones by a post date from low on, or none."""
    dated = F.lit(True)
    undated = F.lit(True)
    if low is not None:
        dated, undated = dated & (due >= low), assigned.isNull() | (assigned >= low)
    if high is not None:
        dated = dated & (due <= high)
    return F.when(due.isNotNull(), dated).otherwise(undated)


def from_parts(year: Column, month: Column, day: Column, hours: Column, minutes: Column, seconds: Column | None = None) -> Column:
    """UTC date and time parts as an instant; null if a date part is missing or zero. Parts beyond their range carry over: 31 February is 3 March, or 2 March."""
    ok = year.between(1, 9999) & (month > 0) & (day > 0)
    first = F.make_date(F.when(ok, year), F.lit(1), F.lit(1))
    date = F.date_add(F.add_months(first, month - 1), day - 1)
    part = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return F.timestamp_seconds(F.unix_date(date) * 86_400 + part(hours) * 3600 + part(minutes) * 60 + part(F.lit(0) if seconds is None else seconds))


def at_time(day: Column, hhmm: Column, zone: str = "UTC") -> Column:
    """A local date at HH:MM, or at 23:59 where that is no time of day."""
    ok = hhmm.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
    time = F.when(ok, F.lpad(hhmm, 5, "0")).otherwise(F.lit("23:59"))
    return F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), time, F.lit(f" {zone}")), F.lit("yyyy-MM-dd HH:mm VV"))


def same_instant(a: Column, b: Column) -> Column:
    """Two RFC 3339 texts compared as instants, else as texts; two nulls are the same."""
    return F.coalesce(strict_instant(a) == strict_instant(b), a.eqNullSafe(b))


def utc_text(t: Column, pattern: str) -> Column:
    """An instant's UTC time in a pattern."""
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), pattern)


def rfc3339(t: Column) -> Column:
    return utc_text(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_around(now: Column, past: int, future: int) -> tuple[Column | None, Column | None]:
    """(low, high): now less and plus so many calendar days; none for a number of 0, which means no bound."""
    return (now - F.expr(f"INTERVAL '{past}' DAY") if past > 0 else None), (now + F.expr(f"INTERVAL '{future}' DAY") if future > 0 else None)


def due_within(due: Column, low: Column | None, high: Column | None) -> Column:
    """Rows by their date alone, both ends included."""
    kept = F.lit(True)
    for bound in ([] if low is None else [due >= low]) + ([] if high is None else [due <= high]):
        kept = kept & bound
    return kept


def seconds_of(interval: Column) -> Column:
    """"36h", "7d", "2w", "90m" or "30s" as seconds, else null."""
    n = F.try_to_number(F.regexp_extract(interval, r"^(\d+)[smhdw]$", 1), F.lit("999999999")).cast("bigint")
    unit = F.regexp_extract(interval, r"^\d+([smhdw])$", 1)
    return n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)


def day_span(start: Column, end: Column) -> tuple[Column, Column]:
    """(start, end) on the start's day: an hour long without an end, clamped to 23:59 if it runs over."""
    given = F.when(end > start, end).otherwise(start + F.expr("INTERVAL '1' HOUR"))
    late = F.date_trunc("day", start) + F.expr("INTERVAL '23:59' HOUR TO MINUTE")
    return start, F.when(F.to_date(given) != F.to_date(start), late).otherwise(given)
