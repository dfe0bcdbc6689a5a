"""Exact quantiles of groups of any size: equal values are counted once, and what is still many is ranked by ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import table

#: Rows, or different values, of a group that one task takes.
SMALL = 100_000


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, shares: Sequence[float], more: Sequence[Column] = (), small: int = SMALL, few: int = SMALL, weight: str | None = None, all_small: bool = False) -> DataFrame:
    """keys, n (values that aren't null), q (an array, one quantile a share), as `percentile` gives them: exact, linear between neighbours.

    Groups of up to `small` rows are left to `percentile`, which keeps a group's values in one task. The others are counted value by
    value, which tasks merge. Where `few` different values or less are left, `percentile` takes these with their counts; else the values are
    dealt by ranges, a row a range tells where a rank falls, and the range is counted through. So no task holds a large group, the rows
    are read three times, and the result is exact. NaN is the greatest value, -0.0 counts as 0.0; a group without values has null.
    `weight` names a column of whole numbers, how often a row counts; `all_small` says that no group is larger, so that none is counted. `more` are further aggregates of the groups, with names.
    """
    keys = list(keys)
    d = df.withColumn("_v", (F.col(value) if isinstance(value, str) else value).cast("double") + F.lit(0.0))
    n, q = _whole(shares, weight)
    plain = lambda rows: rows.groupBy(*keys).agg(n, q, *more)
    if all_small:
        return plain(d)
    named = F.struct(*keys) if keys else F.struct(F.lit(0).alias("one"))
    sizes = d.groupBy(named.alias("_g")).agg(F.count("_v").alias("_n"))
    if sizes.where(F.col("_n") > small).isEmpty():
        return plain(d)
    large = table(sizes.where(F.col("_n") > small), "sizes")
    d = d.withColumn("_g", named)
    rest, big = d.join(large, "_g", "left_anti"), d.join(large, "_g", "left_semi")
    found = _selected(big.where("_v IS NOT NULL").select("_g", "_v", (F.lit(1) if weight is None else F.col(weight)).alias("_w")), list(shares), few)
    whole = found.join(big.groupBy("_g").agg(*more), "_g") if more else found
    of_group = whole.select(*[F.col("_g").getField(k).alias(k) for k in keys], *[c for c in whole.columns if c != "_g"])
    return of_group.unionByName(plain(rest)) if keys else of_group


def _whole(shares: Sequence[float], weight: str | None) -> tuple[Column, Column]:
    """n and q of a group in one task."""
    at = F.array(*[F.lit(float(s)) for s in shares])
    if weight is None:
        return F.count("_v").alias("n"), F.percentile("_v", at).alias("q")
    n = F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col(weight))), F.lit(0)).cast("long")
    return n.alias("n"), F.percentile("_v", at, F.col(weight)).alias("q")


def _selected(rows: DataFrame, shares: list[float], few: int) -> DataFrame:
    """_g, n, q from rows (_g, _v, _w)."""
    counts = table(rows.groupBy("_g", "_v").agg(F.sum("_w").alias("_w")), "counts")
    many = counts.groupBy("_g").agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > few)
    n, q = _whole(shares, "_w")
    if many.isEmpty():
        return counts.groupBy("_g").agg(n, q)
    many = table(many.select("_g"), "many")
    by_ranges = _ranked(counts.join(many, "_g", "left_semi"), shares)
    return by_ranges.unionByName(counts.join(many, "_g", "left_anti").groupBy("_g").agg(n, q))


def _ranked(counts: DataFrame, shares: list[float]) -> DataFrame:
    """_g, n, q from the different values of groups and their counts (_g, _v, _w)."""
    dealt = table(counts.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    along = Window.partitionBy("_g")
    sums = dealt.groupBy("_g", "_part").agg(F.sum("_w").alias("_s"))
    parts = sums.select("_g", "_part", "_s", F.sum("_s").over(along).alias("n"), F.coalesce(F.sum("_s").over(along.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    place = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    wanted = F.array(*[x.cast("long") for s in shares for x in (F.floor(place(s)), F.ceil(place(s)))])
    inside = lambda k, begin, size: (k >= begin) & (k < begin + size)
    ranks = parts.select("*", F.posexplode(wanted).alias("_r", "_k")).where(inside(F.col("_k"), F.col("_base"), F.col("_s")))
    asked = ranks.groupBy("_g", "_part", "n", "_base").agg(F.collect_list(F.struct("_r", "_k")).alias("_ks"))
    so_far = F.col("_base") + F.sum("_w").over(Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    seen = dealt.join(asked, ["_g", "_part"]).withColumn("_end", so_far)
    hit = F.filter("_ks", lambda x: inside(x["_k"], F.col("_end") - F.col("_w"), F.col("_w")))
    by_group = seen.select("_g", "n", "_v", F.explode(hit).alias("_x")).groupBy("_g", "n").agg(F.array_sort(F.collect_list(F.struct("_x._r", "_v"))).alias("_xs"))
    low, high = (lambda i: F.col("_xs")[2 * i]["_v"]), (lambda i: F.col("_xs")[2 * i + 1]["_v"])

    def between(i: int, share: float) -> Column:
        at = F.lit(float(share)) * (F.col("n") - 1)
        return F.when(low(i) == high(i), low(i)).otherwise((F.ceil(at) - at) * low(i) + (at - F.floor(at)) * high(i))

    return by_group.select("_g", "n", F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("q"))
