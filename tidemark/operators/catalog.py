"""A catalog of media files: representative records, days and presence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import HOUR, micros
from .coverage import day_hours, hour_states


def representative_hours(media: DataFrame, source: str, time: str, record: str) -> DataFrame:
    """source, day, hour, record: of each hour the record nearest to its middle, by whole seconds, the earlier of two."""
    us = F.pmod(micros(time), F.lit(HOUR))
    sec = F.floor(us / 1_000_000)
    return media.groupBy(source, F.to_date(time).alias("day"), F.hour(time).alias("hour")).agg(F.min_by(record, F.struct(F.abs(sec - 1800), sec, us)).alias(record))


def hourly_pivot(hours: DataFrame, source: str, record: str, sources: Sequence[str]) -> DataFrame:
    """day, hour and a column a source: its representative record, null without one."""
    return hours.groupBy("day", "hour").pivot(source, list(sources)).agg(F.first(record))


def preferred(media: DataFrame, source: str, time: str, record: str, kind: str, first: str = "video") -> DataFrame:
    """source, day, n, hours, frontier, preferred: of each day how many records and hours there are, the newest time, and the newest record of the preferred kind, or of any."""
    rank = F.when(F.col(kind) == first, 0).otherwise(1)
    return media.groupBy(source, F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.hour(time)).alias("hours"), F.max(time).alias("frontier"), F.min_by(record, F.struct(rank, -micros(time))).alias("preferred"))


def presence(media: DataFrame, source: str, time: str, sources: Sequence[str]) -> DataFrame:
    """day, hour, state: 2 if all sources have a record in the hour, 1 if some have, else 0."""
    return hour_states(day_hours(media, time, [source]), source, sources)
