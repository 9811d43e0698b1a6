"""Date text to moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.scalar import as_col


def _has_zone(text: Column) -> Column:
    return text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d{2}:\d{2}")


def parse_moment(text) -> Column:
    """Text to a moment: an offset is honoured, text without one is UTC; unreadable text is NULL."""
    t = F.trim(as_col(text))
    return F.when(_has_zone(t), t.try_cast("timestamp")).otherwise(
        F.concat(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00"))).otherwise(t), F.lit("+00:00")).try_cast("timestamp"))


def parse_until(text) -> Column:
    """As ``parse_moment``, but a bare date means the last second of that day."""
    t = F.trim(as_col(text))
    bare = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(bare, F.timestamp_seconds(F.unix_seconds(parse_moment(t)) + 86399)).otherwise(parse_moment(t))


def local_midnight(day, zone: str = "Europe/Berlin") -> Column:
    """Start of a local calendar day as a moment (daylight saving included)."""
    return F.to_utc_timestamp(as_col(day).cast("date").cast("timestamp"), zone)
