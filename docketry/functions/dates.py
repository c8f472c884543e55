"""Dates kept as ISO text, and the four point-in-time rules.

The rules differ on undated rows, so each has its own name.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import blank_to_null, strip

ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def require_iso(value: str, name: str = "as_of_date") -> str:
    """Check a caller's date; the value is returned trimmed."""
    text = (value or "").strip()
    if not re.match(ISO, text):
        raise ValueError(f"{name} must look like YYYY-MM-DD, got {value!r}")
    return text


def optional_calendar_date(value: str | None) -> str | None:
    """Check a caller's optional date against the calendar; blank means none."""
    text = "" if value is None else str(value).strip()
    if not text:
        return None
    try:
        dt.date.fromisoformat(text[:10])
    except ValueError as exc:
        raise ValueError(f"as_of_date must look like YYYY-MM-DD, got {value!r}") from exc
    return text[:10]


def in_force_strict(effective: Column, as_of: str) -> Column:
    """Search rule: only a well-formed date on or before ``as_of`` passes."""
    value = strip(F.coalesce(effective, F.lit("")))
    return value.rlike(ISO) & (value <= as_of)


def in_force_lenient(effective: Column, as_of: str | None) -> Column:
    """Bundle rule: undated rows pass."""
    if not as_of:
        return F.lit(True)
    value = F.nullif(effective, F.lit(""))
    return F.coalesce(F.substring(value, 1, 10) <= as_of[:10], F.lit(True))


def in_force_listed(effective: Column, as_of: str) -> Column:
    """Listing rule: undated rows fail; only the first ten characters count."""
    value = F.nullif(effective, F.lit(""))
    return F.coalesce(F.substring(value, 1, 10) <= as_of[:10], F.lit(False))


def registry_date(raw: Column) -> Column:
    """``20240703`` or ``2024.07.03`` → ``2024-07-03``; other text is kept, blank is null."""
    text = blank_to_null(raw)
    digits = F.regexp_replace(text, r"(?U)\D", "")
    iso = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(F.length(digits) == 8, iso).otherwise(text)


def in_force_if_known(effective: Column, as_of: Column) -> Column:
    """Verification rule: an unknown date on either side does not block."""
    return F.coalesce(registry_date(effective) <= registry_date(as_of), F.lit(True))


def force_status(effective: Column, today: str) -> Column:
    """미상 when undated, 시행예정 when later than ``today``, else 현행."""
    value = strip(F.coalesce(effective, F.lit("")))
    return F.when(value == "", "미상").when(value > today, "시행예정").otherwise("현행")
