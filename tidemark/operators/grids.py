"""Grids of time and height: ranks of an axis and coarsening to a target size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import HOUR, micros
from ..sources.scratch import table
from .clean import window_slice


def ranked(values: DataFrame, column: str) -> DataFrame:
    """column, _i, _n: the distinct values of a column with their place, from 0 on, and their number.

    Values are dealt by range and ordered inside their part; a place is the place in the part and the size of the parts
    before, of which there are as many as the session's shuffles have.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.select(column).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    dealt = table(dealt.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "axis")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"), F.min("_at").alias("_start"))
    along = Window.orderBy("_part")  # a row a part
    shift = counts.select("_part", (F.coalesce(F.sum("_m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_start")).alias("_shift"), F.sum("_m").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    return dealt.join(F.broadcast(shift), "_part").select(column, (F.col("_at") + F.col("_shift")).alias("_i"), "_n")


def sampling_targets(hours: float | None, height: float | None, quality: str = "full") -> tuple[int, int, int]:
    """stride in time, most times and most heights of a view of so many hours and metres: short and shallow ones keep detail.

    quality: full, coarse (a third of the times, half of the heights), or summary_full_time (all times stay).
    """
    stride, times, heights = 2, 300, 200
    for limit, most in ((2, 1200), (6, 800), (24, 400)):
        if hours is not None and hours <= limit:
            stride, times = 1, most
            break
    for limit, most in ((1000, 400), (3000, 300)):
        if height is not None and height <= limit:
            heights = most
            break
    if quality == "coarse":
        stride, times, heights = max(stride, 2), max(96, times // 3), max(72, heights // 2)
    return stride, times, heights


def _centre(column: str, kind: str, block: str) -> Column:
    """The mean of a block's values of an axis; of times to the microsecond."""
    w = Window.partitionBy(block)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        t, first = micros(column), F.min(micros(column)).over(w)
        return F.timestamp_micros(first + F.floor(F.avg(t - first).over(w))).cast("timestamp_ntz")
    return F.avg(F.col(column).cast("double")).over(w)


def coarsen(grid: DataFrame, value: str, factors: Mapping[str, int] | None = None, most: Mapping[str, int] | None = None) -> DataFrame:
    """Means of blocks of consecutive values of the axes, one axis after the other; a block lies at the mean of its values, incomplete ones at the end go.

    An axis gets the factor told in `factors`, or the least one that leaves at most `most` blocks. Axes with factor 1 keep their values, others become
    times without a zone or doubles. Cells that are missing count in no mean.
    """
    out, axes, kinds = grid, {**dict.fromkeys(most or {}), **(factors or {})}, dict(grid.dtypes)
    for c, factor in axes.items():
        r = ranked(grid.where(F.col(c).isNotNull()), c)
        k = F.lit(factor).cast("long") if factor else F.when(F.col("_n") > most[c], F.ceil(F.col("_n") / most[c])).otherwise(1)
        at = r.withColumn("_k", k).withColumn("_b", F.expr("_i div _k")).where("(_b + 1) * _k <= _n").withColumn("_c", _centre(c, kinds[c], "_b")).select(c, "_c")
        rest = [x for x in grid.columns if x not in (c, value)]
        out = out.join(at, c).groupBy(*rest, "_c").agg(F.avg(value).alias(value)).withColumnRenamed("_c", c)
    return out.select(*grid.columns)


def window_view(grid: DataFrame, time: str, height: str, value: str, start: str, end: str, bottom: float | None = None, top: float | None = None, load_top: float = 10_000.0, quality: str = "full") -> DataFrame:
    """A grid's closed window of time and height, thinned and coarsened to what a view of its length and height needs; nothing if start isn't before end.

    Times are strided first; then heights, and times, are averaged in blocks if there are more than the target.
    """
    span = grid.sparkSession.range(1).select(((micros(F.lit(end)) - micros(F.lit(start))) / HOUR).alias("hours")).first()["hours"]
    low, high = max(bottom or 0.0, 0.0), min(load_top if top is None else top, load_top)
    told = None if bottom is None and top is None else max((load_top if top is None else top) - low, 0.0)
    stride, times, heights = sampling_targets(span, told, quality)
    seen = window_slice(grid, time, start, end).where(F.col(height).between(0.0 if told is None else low, high))
    if quality != "summary_full_time" and stride > 1:
        seen = seen.join(ranked(seen, time).where(F.col("_i") % stride == 0).select(time), time)
    most = {height: heights} | ({} if quality == "summary_full_time" else {time: times})
    return coarsen(seen, value, most=most).select(*grid.columns)
