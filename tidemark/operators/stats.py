"""Robust statistics, scores and runs by label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import table
from .quantiles import SMALL, quantiles


def latency_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, p50, p95 and max per group; quantiles are exact and interpolate linearly, and no group meets in a task."""
    g = quantiles(df, keys, value, [0.5, 0.95], [F.avg(value).alias("mean"), F.max(value).alias("max")])
    return g.select(*keys, "n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "max")


def middle(rows: DataFrame, keys: Sequence[str], value: str, name: str, floor: float, weight: str | None = None) -> DataFrame:
    """keys, `name` (the median), _scale, _n per group; `weight` is how often a row counts."""
    keys = list(keys)
    med = table(quantiles(rows, keys, value, [0.5], weight=weight).select(*keys, F.col("q")[0].alias(name), F.col("n").alias("_size")), "medians")
    known = med.where(F.col("_size") > SMALL).isEmpty()  # the distances' groups have the same rows
    dev = quantiles(rows.join(med.drop("_size"), keys), [*keys, name], F.abs(F.col(value) - F.col(name)), [0.5], weight=weight, all_small=known)
    return dev.select(*keys, name, F.greatest(F.lit(floor), F.col("q")[0] * 1.4826).alias("_scale"), F.col("n").alias("_n"))


def robust_kept(df: DataFrame, keys: Sequence[str], value: str, floor: float = 3.0, factor: float = 5.0, least: float = 20.0, weight: str | None = None) -> DataFrame:
    """`df` without values farther than max(factor * scale, least) from their group's median."""
    first = middle(df, keys, value, "_m", floor, weight).drop("_n")
    return df.join(first, list(keys)).where(F.abs(F.col(value) - F.col("_m")) <= F.greatest(factor * F.col("_scale"), F.lit(least))).drop("_m", "_scale")


def robust_scale(df: DataFrame, keys: Sequence[str], value: str, floor: float = 3.0, factor: float = 5.0, least: float = 20.0, weight: str | None = None) -> DataFrame:
    """median, scale, n per group after rejecting values farther than max(factor * scale, least) from a first median.

    scale is 1.4826 times the median absolute deviation, at least `floor`.
    """
    return middle(robust_kept(df, keys, value, floor, factor, least, weight), keys, value, "median", floor, weight).select(*keys, "median", F.col("_scale").alias("scale"), F.col("_n").alias("n"))


def error_metrics(error: Column) -> list[Column]:
    return [F.count(error).alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"), F.sqrt(F.avg(error * error)).alias("rmse")]


def lead_bucket(lead: Column) -> Column:
    """Half-open lead ranges in hours; null outside."""
    return F.when((lead >= 0) & (lead < 6), "0-6").when((lead >= 6) & (lead < 24), "6-24").when((lead >= 24) & (lead < 48), "24-48").when((lead >= 48) & (lead < 96), "48-96")


def crps(members: Column, observed: Column) -> Column:
    """Mean distance to the observation less half the mean distance between all pairs of members; null below two members."""
    x, m = F.array_sort(members), F.size(members)
    near = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v - observed)) / m
    spread = F.aggregate(F.transform(x, lambda v, i: (2 * (i + 1) - m - 1) * v), F.lit(0.0), lambda a, v: a + v) / (m * m)
    return F.when(m >= 2, near - spread)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share p of n."""
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


LEVELS = ("gray", "green", "amber", "red")


def level(value: Column, amber: float, red: float) -> Column:
    return F.when(value.isNull(), "gray").when(value >= red, "red").when(value >= amber, "amber").otherwise("green")


def worst(level_: Column) -> Column:
    """Aggregate: the worst level of a group; gray counts only if there is nothing else."""
    rank = F.max(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level_))
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank.cast("int"))


def below(value: Column, amber: float, red: float) -> Column:
    """Levels of what is bad when low: red below `red`, amber below `amber`."""
    return F.when(value.isNull(), "gray").when(value < red, "red").when(value < amber, "amber").otherwise("green")


def count_level(n: Column, amber: float = 1.0) -> Column:
    """green at 0, amber up to `amber`, else red."""
    return F.when(n.isNull(), "gray").when(n <= 0, "green").when(n <= amber, "amber").otherwise("red")


def age_level(age: Column, green: float = 10.0, amber: float = 30.0) -> Column:
    return F.when(age.isNull(), "gray").when(age <= green, "green").when(age <= amber, "amber").otherwise("red")


def band_level(value: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """`low` and `high` are (red, amber): red below low's or from high's first bound, amber likewise by the second."""
    return F.when(value.isNull(), "gray").when((value < low[0]) | (value >= high[0]), "red").when((value < low[1]) | (value >= high[1]), "amber").otherwise("green")


def margin_level(margin: Column, available: Column, red: float = 0.0) -> Column:
    """Dew point margin: gray where the humidity isn't available, red at `red` and below."""
    return F.when(F.coalesce(~available, F.lit(False)) | margin.isNull(), "gray").when(margin <= red, "red").otherwise("green")


def depletion_level(watts: Column, soc: Column, hours: Column, capacity_kwh: float = 26.0, deadband: float = 50.0, green: float = 24.0, amber: float = 12.0) -> Column:
    """Hours until a battery is empty, told or from its charge and power; green unless it is discharged beyond the deadband."""
    left = F.coalesce(hours, F.greatest(soc, F.lit(0.0)) / 100 * capacity_kwh / (F.abs(watts) / 1000))
    return F.when(watts.isNull() | soc.isNull(), "gray").when(watts >= -deadband, "green").when(left >= green, "green").when(left >= amber, "amber").otherwise("red")
