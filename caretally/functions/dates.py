"""Reading, comparing and bucketing dates.

Text that is not a date becomes null, never an error and never a marker; the
marker text belongs to the report (``or_marker``).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers the reports print.
NO_RESULT = "Sin Resultados"
NO_REVIEW = "Sin revisión"
NO_NOTES = "SIN NOTES"
BAD_DATE = "Fecha no válida"
# Fixed value: timestamps in this year mean "not happened".
SENTINEL_YEAR = 1901


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _one_blank(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\s+", " ")


def _parse(c: Column, *formats: str) -> Column:
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def parse_stamp(c: Column | str) -> Column:
    """``Nov  1 2023  9:05AM`` -> timestamp."""
    return _parse(_one_blank(c), "MMM d yyyy h:mma")


def parse_day_first(c: Column | str) -> Column:
    """``31/12/2023`` -> date."""
    return _parse(_col(c), "d/M/yyyy").cast("date")


_MONTH_FIRST = ("M/d/yyyy h:mm a", "M/d/yyyy H:mm", "M/d/yyyy")
# What these formats read as a rule, every field within its range; and whatever else.
_USUAL = (
    r"(?s)^(?:(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/(\d{4})"
    r"(?: (?:[01]?\d|2[0-3]):[0-5]\d| (?:0?[1-9]|1[0-2]):[0-5]\d [AaPp][Mm])?|.*)\z"
)
# Usual digits, within their range or not, or less than two slashes.
_NO_OTHER = r"(?s)^(?:\d{1,2}/\d{1,2}/\d{4}(?: \d{1,2}:\d\d(?: [AaPp][Mm])?)?|[^/]*(?:/[^/]*)?)\z"


def _parse_unusual(text: Column) -> Column:
    # An array's function names the text once, however often the formats do.
    left = F.filter(F.array(text), lambda t: ~t.rlike(_NO_OTHER))
    return F.get(F.transform(left, lambda t: _parse(t, *_MONTH_FIRST).cast("date")), F.lit(0))


def parse_month_first(c: Column | str) -> Column:
    """``1/5/2023 3:04 pm``, ``01/05/2023 23:04`` or ``01/05/2023`` -> date.

    A format that does not fit costs many times a parse (Spark raises and catches an
    exception), so the day of a usual text is turned round and cast, its time of day only
    checked, and texts that no format reads are not tried. The text is named as seldom as
    can be: filters repeat its expression, also one parse within another.
    """
    text = _one_blank(c)
    usual = F.regexp_replace(text, _USUAL, "$3-$1-$2").try_cast("date")
    return F.coalesce(usual, _parse_unusual(text))


def standard_date(c: Column | str) -> Column:
    """The same texts as ``MM/dd/yyyy``, or null."""
    return F.date_format(parse_month_first(c), "MM/dd/yyyy")


def or_marker(c: Column | str, marker: str) -> Column:
    """Report edge only: print a marker in place of null."""
    return F.coalesce(_col(c).cast("string"), F.lit(marker))


def happened(c: Column | str) -> Column:
    """True for a real timestamp; false for the sentinel year; null for null."""
    return F.year(_col(c)) != SENTINEL_YEAR


def lag(start: Column | str, end: Column | str) -> Column:
    """Interval from start to end, null if the end is the sentinel."""
    return F.when(happened(end), _col(end) - _col(start))


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Whole 24-hour days, rounded down: minus 1 for a negative part-day."""
    seconds = (_col(end).cast("timestamp_ntz") - _col(start).cast("timestamp_ntz")).cast("interval second")
    return F.floor(seconds.cast("decimal(20,6)") / F.lit(86400)).cast("long")


def calendar_days(start: Column | str, end: Column | str) -> Column:
    """Difference of the calendar dates, whatever the time of day."""
    return F.datediff(_col(end), _col(start)).cast("long")


def lag_text(interval: Column) -> Column:
    """Interval as ``N days HH:MM:SS``, the report's rendering. The day part is
    rounded down and the clock part counts up from it."""
    seconds = interval.cast("interval second").cast("decimal(20,6)")
    days = F.floor(seconds / F.lit(86400)).cast("long")
    rest = F.floor(seconds - days * F.lit(86400)).cast("int")
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.when(interval.isNotNull(), F.concat(days.cast("string"), F.lit(" days "), clock))


# Upper bounds, in whole days, of the first four lag buckets.
LAG_BOUNDS = (3, 5, 7, 14)


def lag_bucket(days: Column | str) -> Column:
    """1: <=3, 2: (3,5], 3: (5,7], 4: (7,14], 5: >14; null for null."""
    d = _col(days)
    chain = F.when(d <= LAG_BOUNDS[0], 1)
    for number, bound in enumerate(LAG_BOUNDS[1:], start=2):
        chain = chain.when(d <= bound, number)
    return chain.when(d > LAG_BOUNDS[-1], len(LAG_BOUNDS) + 1)


def within(days: Column | str, limit: int = 5) -> Column:
    """1 if the lag is known and at most ``limit`` days, else 0."""
    return F.when(_col(days) <= limit, 1).otherwise(0)


def week_bucket(day: Column | str) -> Column:
    """Part of the month by day number: S1 to 7, S2 to 15, S3 to 23, then S4."""
    d = _col(day)
    return F.when(d <= 7, "S1").when(d <= 15, "S2").when(d <= 23, "S3").when(d > 23, "S4")


def in_month(c: Column | str, year: int, month: int) -> Column:
    """A range test, so that it reaches the scan."""
    nxt = date(year + month // 12, month % 12 + 1, 1)
    return (_col(c) >= F.lit(date(year, month, 1))) & (_col(c) < F.lit(nxt))


def in_range(c: Column | str, start: date, end: date) -> Column:
    """start <= c < end."""
    return (_col(c) >= F.lit(start)) & (_col(c) < F.lit(end))


def until(c: Column | str, cutoff: str, mode: str = "date") -> Column:
    """``MM/dd/yyyy`` text up to a cut-off of the same form.

    ``date`` compares days. ``text`` compares characters, by which 01/15/2024
    comes before 12/01/2023.
    """
    if mode == "text":
        return _col(c) <= F.lit(cutoff)
    if mode == "date":
        return parse_month_first(c) <= parse_month_first(F.lit(cutoff))
    raise ValueError(f"unknown mode: {mode}")
