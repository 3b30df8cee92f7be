"""Fields out of JSON logs, free-text notes and joined labels; name tests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns searched for in visit notes.
DOB = r"DOB: (\d{2}/\d{2}/\d{4})"
PHONE = r"\(\d{3}\)\s\d{3}-\d{4}"
ID_8 = r"\d{8}"
EMAIL = r"\S+@\S+"
# Text that any match of a pattern holds.
FIXED_PART = {DOB: "DOB: ", PHONE: "(", EMAIL: "@"}


def booking_id(label: str) -> str:
    """Pattern of ``<label>: 123``."""
    return label + r":\s\d+"


# Fields of the booking log.
LOG_FIELDS = ("FacilityName", "VisitType", "NewPatient", "Reason", "VisitStatus", "Notes", "ProviderName")


END_MARK = "end of the log entry"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed_log(c: Column | str) -> Column:
    """``{field: {OldValue, NewValue}}`` text as a VARIANT, parsed once for all the fields; null for malformed text.

    The text is parsed as the first element of an array that ends in a mark: whatever
    follows the object then breaks the array or stands in the mark's place, and the text is
    refused. Keep the result as a column and take ``new_value`` of that column per field:
    spelled out per field, Spark would parse the text again for each.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), _col(c), F.lit(f', "{END_MARK}"]')))
    return F.when(F.try_variant_get(parsed, "$[1]", "string") == END_MARK, parsed)


def new_value(parsed: Column | str, field: str) -> Column:
    """NewValue of a field as text, JSON text for an object or array; null if the field is
    missing or no object, or the text was malformed."""
    return F.try_variant_get(_col(parsed), f"$[0]['{field}'].NewValue", "string")


def first_match(c: Column | str, *patterns: str) -> Column:
    """What the first matching pattern captures (its group, or the whole match, neither of
    which may be empty); null for null, blank or unmatched text. Each pattern runs once,
    and not at all on texts without its fixed part."""
    text = _col(c)

    def found(pattern: str) -> Column:
        fixed = FIXED_PART.get(pattern)
        hit = F.nullif(F.regexp_extract(text, pattern, 1 if _has_group(pattern) else 0), F.lit(""))
        return hit if fixed is None else F.when(text.contains(fixed), hit)

    return F.coalesce(*[found(p) for p in patterns])


def _has_group(pattern: str) -> bool:
    return "(" in pattern.replace(r"\(", "").replace("(?", "")


def split_two(c: Column | str, separator: str = ":") -> tuple[Column, Column]:
    """Both sides of the first separator; the second is null without one."""
    parts = F.split(_col(c), f"\\Q{separator}\\E", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def like_any_case(c: Column | str, pattern: str) -> Column:
    """LIKE that ignores case, as the local reports' engine does."""
    return _col(c).ilike(pattern)


def contains_none(c: Column | str, patterns: Iterable[str]) -> Column:
    """NOT LIKE each of the patterns. A null text fails the test."""
    test = F.lit(True)
    for p in patterns:
        test = test & ~like_any_case(c, p)
    return test


def is_zero(c: Column | str) -> Column:
    """0 as a number or as text."""
    return _col(c).try_cast("bigint") == 0
