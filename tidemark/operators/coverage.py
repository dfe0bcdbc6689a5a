"""Presence of rows as bitmaps that merge: the hours of a day, and the segments of a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import HOUR, micros


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def day_hours(df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    """keys, day, hours: a row a day, bit h set if the hour h has a row. A strip is made of these small rows; new files only add theirs."""
    return df.where(F.col(time).isNotNull()).groupBy(*keys, F.to_date(time).alias("day")).agg(F.bit_or(_bit(F.hour(time))).alias("hours"))


def merged(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Bitmaps of several sources, or of a store and what is new, as one: repeats change nothing."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys, "day").agg(F.bit_or("hours").alias("hours"))


def hour_coverage(bitmaps: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """keys, seen, missing, expected: hours from that of start to that of end, both included, of each key; the order of times is the caller's."""
    a, z = (F.date_trunc("hour", F.lit(x).cast("timestamp_ntz")).cast("timestamp_ntz") for x in (start, end))
    midnight = micros(F.col("day").cast("timestamp_ntz"))
    first, last = F.expr(f"least(24, greatest(0, ({_us(a, bitmaps)} - _m) div {HOUR}))"), F.expr(f"least(23, greatest(-1, ({_us(z, bitmaps)} - _m) div {HOUR}))")
    inside = _bit(last + 1) - _bit(first)
    expected = (_us(z, bitmaps) - _us(a, bitmaps)) // HOUR + 1
    rows = bitmaps.withColumn("_m", midnight).withColumn("_in", F.when(last >= first, F.bit_count(F.col("hours").bitwiseAND(inside))).otherwise(0))
    return rows.groupBy(*keys).agg(F.sum("_in").cast("long").alias("seen")).withColumn("missing", F.lit(expected) - F.col("seen")).withColumn("expected", F.lit(expected).cast("long"))


def _us(c: Column, df: DataFrame) -> int:
    """A constant time in microseconds."""
    return df.sparkSession.range(1).select(micros(c).alias("t")).first()["t"]


def segment_bits(df: DataFrame, time: str, keys: Sequence[str], start: str, end: str, segments: int = 64) -> DataFrame:
    """keys, bits (segment s of the window is bit s, 64 at most), seen, missing: equal parts from start to end, the last one with its end; keys without rows in the window have no row."""
    if not 1 <= segments <= 64:
        raise ValueError("a bitmap has 64 segments at most")
    a, z = (_us(F.lit(x).cast("timestamp_ntz"), df) for x in (start, end))
    if z <= a:
        raise ValueError("the window ends before it starts")
    t = micros(time)
    place = F.least(F.lit(segments - 1), F.floor((t - a) * segments / (z - a)))
    g = df.where(t.between(a, z)).groupBy(*keys).agg(F.bit_or(_bit(place)).alias("bits"))
    seen = F.bit_count("bits").cast("long")
    return g.withColumn("seen", seen).withColumn("missing", segments - seen)


def hour_states(bitmaps: DataFrame, source: str, sources: Sequence[str]) -> DataFrame:
    """day, hour, state for each hour of each day: 2 if all `sources` have rows, 1 if some have, else 0."""
    bits = [F.bit_or(F.when(F.col(source) == s, F.col("hours")).otherwise(0)).alias(f"_{i}") for i, s in enumerate(sources)]
    days = bitmaps.groupBy("day").agg(*bits).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    n = sum(((F.col(f"_{i}").bitwiseAND(_bit(F.col("hour"))) != 0).cast("int") for i in range(len(sources))), F.lit(0))
    return days.select("day", "hour", F.when(n == len(sources), 2).when(n > 0, 1).otherwise(0).alias("state"))
