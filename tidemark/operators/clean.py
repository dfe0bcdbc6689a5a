"""Coercion, filters and de-duplication of raw rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """A double, null for text that is none and for NaN and infinities."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Without the columns that have no value; one aggregation decides."""
    rest = [c for c in df.columns if c not in keep]
    counts = df.agg(*[F.count(c).alias(c) for c in rest]).first()
    return df.select(*[c for c in df.columns if c in keep or counts[c]])


def since(df: DataFrame, time: str, cutoffs: Sequence[str]) -> DataFrame:
    """Rows at or after the latest cutoff; cutoffs are ISO texts, without a zone in UTC."""
    from datetime import UTC, datetime

    told = [datetime.fromisoformat(c.replace("Z", "+00:00")) for c in cutoffs]
    naive = [t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t for t in told]
    return df.where(F.col(time) >= F.lit(str(max(naive))).cast("timestamp_ntz")) if naive else df


def window_slice(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Rows of the closed window; none if start isn't before end."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.where((a < b) & F.col(time).between(a, b))


def drop_bogus_future(df: DataFrame, time: str, now: str, days: int = 2) -> DataFrame:
    """Rows not later than `days` from now; if that leaves none, all rows with a time."""
    ok = F.col(time) <= F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(days))
    any_ok = df.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("_any"))
    return df.crossJoin(F.broadcast(any_ok)).where(F.col(time).isNotNull() & (ok | ~F.col("_any"))).drop("_any")


def apply_rules(df: DataFrame, name: str, value: str, rules: DataFrame) -> DataFrame:
    """Values outside a trace's valid range become null, the others are scaled; rules: name, low, high, scale, one row a trace kind."""
    kept = F.when(F.col(value).between(F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf")))), F.col(value) * F.coalesce("scale", F.lit(1.0)))
    return df.join(rules, name, "left").withColumn(value, kept).drop("low", "high", "scale")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the order. Spark prunes to a row a task and key before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def spread_duplicates(df: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Rows that share a time are spread evenly up to the next time, at steps of 1 ms to 1 s.

    The last block of a series takes the gap before it; a series of one block is spread at 1 s.
    """
    from ..functions.times import SECOND, micros

    us = micros(time)
    blocks = df.select(key, time).groupBy(key, time).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy(time)
    gap = F.coalesce(F.lead(us).over(w) - us, us - F.lag(us).over(w), F.lit(SECOND))
    steps = blocks.withColumn("_step", F.greatest(F.lit(1000), F.least(F.lit(SECOND), F.floor(gap / F.col("_n")))))
    nth = F.row_number().over(Window.partitionBy(key, time).orderBy(order)) - 1
    return df.join(steps, [key, time]).withColumn("time_us", us + nth * F.col("_step")).drop("_n", "_step")


def schema_difference(own: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of names that only `own` has (`kind` extra) or only `store` has (missing), once each."""
    return own.subtract(store).withColumn("kind", F.lit("extra")).union(store.subtract(own).withColumn("kind", F.lit("missing")))
