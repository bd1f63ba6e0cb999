"""Rounding and other small expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column, digits: int) -> Column:
    """Half up by plain arithmetic, the same in every engine."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def bucket(t: Column, seconds: int) -> Column:
    """Start of the tumbling window that an epoch second lies in (F1, ST1)."""
    return (F.floor(t / seconds) * seconds).cast("long")


def severity(score: Column) -> Column:
    """F12."""
    return F.when(score >= 0.9, "high").when(score >= 0.65, "medium").otherwise("low")


def iso(t: Column) -> Column:
    """Epoch seconds as ISO-8601 in UTC, whatever the session's zone (F2)."""
    return F.date_format(F.timestamp_seconds(t).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def number(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def thousands(c: Column) -> Column:
    """Whole numbers with separators."""
    return F.format_number(c, 0)


def epoch_day(c: Column) -> Column:
    """Days since 1970 of a date like 01/04/2010 07:31:14, month first; null where it is none."""
    return F.datediff(F.try_to_timestamp(F.trim(c), F.lit("M/d/yyyy H:m:s")), F.lit("1970-01-01").cast("date"))


def alert_id(keys: tuple[str, ...] = ("source", "alert_type", "entity_type", "entity_id", "t")) -> Column:
    """A digest of what names an alert (F34): a job that runs again gives it the same id, unlike a random one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)
