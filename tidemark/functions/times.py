"""Times as microseconds; all times are naive UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def micros(c: Column | str) -> Column:
    """Microseconds since 1970; the session's zone is UTC, in which the naive times are read."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def bucket(c: Column | str, minutes: int) -> Column:
    """Left-closed bucket of a width that divides a day."""
    c = F.col(c) if isinstance(c, str) else c
    return F.window(c, f"{minutes} minutes")["start"]


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds."""
    return (micros(b) - micros(a)) / SECOND
