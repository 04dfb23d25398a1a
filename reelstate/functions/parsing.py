"""Typed parts of the text fields.

Malformed text gives NULL parts and never fails the job; callers keep the raw
column beside the parts.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


# Days that a day-time interval of microseconds holds.
MOST_DAYS = 106_751_991
# Wide enough for any digits that a confidence may have.
CONFIDENCE = "decimal(38,20)"


def _part(text: Column, separator: str, index: int, kind: str) -> Column:
    parts = F.split(text, separator)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(index)).try_cast(kind))


def confidence_parts(confidence: Column) -> tuple[Column, Column]:
    """``0.98_0.95`` as two decimals."""
    return (
        _part(confidence, "_", 0, CONFIDENCE),
        _part(confidence, "_", 1, CONFIDENCE),
    )


def resolution_parts(resolution: Column) -> tuple[Column, Column]:
    """``1920x1080`` as width and height."""
    return _part(resolution, "x", 0, "int"), _part(resolution, "x", 1, "int")


def media_seconds(offset: Column) -> Column:
    """``mm:ss`` as whole seconds. This is an offset in the media, not a wall clock."""
    minutes = _part(offset, ":", 0, "bigint")
    seconds = _part(offset, ":", 1, "bigint")
    valid = (minutes >= 0) & seconds.between(0, 59)
    return F.when(valid, F.try_add(F.try_multiply(minutes, F.lit(60)), seconds))


def media_interval(offset: Column) -> Column:
    """``mm:ss`` as a day-time interval; NULL beyond the days that an interval can hold."""
    whole = media_seconds(offset)
    days = F.when(whole < MOST_DAYS * 86_400, F.floor(whole / 86_400).cast("int"))
    rest = (whole % 86_400).cast("decimal(18,6)")
    return F.when(days.isNotNull(), F.make_dt_interval(days, F.lit(0), F.lit(0), rest))


def media_offset(seconds: Column) -> Column:
    """Whole seconds as ``mm:ss``; minutes take as many digits as they need."""
    whole = seconds.cast("bigint")
    return F.concat(padded(F.floor(whole / 60), 2), F.lit(":"), padded(whole % 60, 2))


def padded(number: Column, digits: int) -> Column:
    """A whole number with zeros before it, never cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))
