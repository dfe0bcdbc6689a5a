"""The widest gap between the values of a group, without sorting the group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import table
from . import blocks


def widest_gap(df: DataFrame, keys: Sequence[str], value: str, measure: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """keys, n, low, high, gap: the neighbours in the order of values that are farthest apart by `measure`, the lowest of several; null below two values.

    `measure` grows with the value. Of n values in n + 1 equal parts of their range two neighbours lie farther apart than a part
    is wide, so the widest gap is one between parts, and each part's least and greatest value, which tasks merge, tell it. Parts
    follow each other in blocks, so a group of any size is many tasks. Null and NaN values don't count.
    """
    keys = list(keys)
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.struct(*keys).alias("_g"), F.col(value).cast("double").alias("_v"))
    ends = table(v.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")), "ranges")
    span = measure(F.col("_max")) - measure(F.col("_min"))
    part = F.least(F.col("n"), F.floor((measure(F.col("_v")) - measure(F.col("_min"))) / span * (F.col("n") + 1)))
    parts = v.join(ends.where(F.col("_max") > F.col("_min")), "_g").groupBy("_g", F.timestamp_micros(part).alias("_part")).agg(F.min("_v").alias("high"), F.max("_v").alias("_top"))
    seen = blocks.before(parts, "_g", "_part", ["_top"], block_us=4096).where("_before IS NOT NULL").withColumn("low", F.col("_before._top"))
    best = seen.groupBy("_g").agg(F.max(F.struct((measure(F.col("high")) - measure(F.col("low"))).alias("gap"), (-F.col("low")).alias("_low"), "high")).alias("_b"))
    same = F.col("n") > 1  # all values alike: a gap of 0
    out = ends.join(best, "_g", "left")
    told = lambda c, other: F.coalesce(c, F.when(same, other))
    return out.select(*[F.col("_g").getField(k).alias(k) for k in keys], "n", told(-F.col("_b._low"), F.col("_min")).alias("low"), told(F.col("_b.high"), F.col("_min")).alias("high"), told(F.col("_b.gap"), F.lit(0.0)).alias("gap"))
