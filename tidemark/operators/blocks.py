"""Long series in blocks of time: predecessors, running sums, places and runs, without a task that holds a whole series.

A series is cut into blocks of `block_us` microseconds. Each block is summed up in one row (its first and last row, its number of
rows or its sum), these few rows are chained by a window per series, and what they give is joined back to the block's rows. So
a series is as many tasks as it has blocks, and no row is multiplied. Rows that share a time are in no certain order, unless
a column is told to break the tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY, micros

AT = ["_key", "_block"]


def listed(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def placed(df: DataFrame, key: str | Sequence[str], time: str, block_us: int = DAY) -> DataFrame:
    """`df` with _key (the keys in a struct, so that null keys are equal), _t (microseconds) and _block."""
    t = micros(time)
    return df.withColumns({"_key": F.struct(*listed(key)), "_t": t, "_block": F.expr("0L") + F.floor((t - F.pmod(t, F.lit(block_us))) / block_us)})


def _chain() -> Window:
    return Window.partitionBy("_key").orderBy("_block")


def _so_far(value: str | Column) -> Column:
    """The sum over the blocks before, 0 for the first."""
    return F.coalesce(F.sum(value).over(_chain().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def before(df: DataFrame, key: str | Sequence[str], time: str, columns: Sequence[str] = (), block_us: int = DAY) -> DataFrame:
    """`df` with _before: time in microseconds (_t) and `columns` of the row before in its series, null for the first; `columns` break ties."""
    d = placed(df, key, time, block_us).withColumn("_row", F.struct("_t", *columns))
    ends = d.groupBy(*AT).agg(F.max("_row").alias("_last"))
    carried = ends.select(*AT, F.lag("_last").over(_chain()).alias("_carried"))
    own = F.lag("_row").over(Window.partitionBy(*AT).orderBy("_row"))
    return d.join(carried, AT).withColumn("_before", F.coalesce(own, "_carried")).drop("_key", "_t", "_block", "_row", "_carried")


def running_sum(df: DataFrame, key: str | Sequence[str], time: str, value: str | Column, name: str, order: Sequence[str] = (), block_us: int = DAY) -> DataFrame:
    """`df` with the sum of `value` up to each row of its series; `order` breaks ties of time."""
    d = placed(df, key, time, block_us).withColumn("_v", value if isinstance(value, Column) else F.col(value))
    base = d.groupBy(*AT).agg(F.sum("_v").alias("_s")).select(*AT, _so_far("_s").alias("_base"))
    own = F.sum("_v").over(Window.partitionBy(*AT).orderBy("_t", *order).rowsBetween(Window.unboundedPreceding, 0))
    return d.join(base, AT).withColumn(name, F.col("_base") + own).drop("_key", "_t", "_block", "_v", "_base")


def numbered(df: DataFrame, key: str | Sequence[str], time: str, order: Sequence[str] = (), block_us: int = DAY) -> DataFrame:
    """`df` with _i, the place of a row in its series from 0 on, and _n, the number of the series' rows."""
    d = placed(df, key, time, block_us)
    counts = d.groupBy(*AT).agg(F.count(F.lit(1)).alias("_m"))
    base = counts.select(*AT, _so_far("_m").alias("_base"), F.sum("_m").over(Window.partitionBy("_key")).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*AT).orderBy("_t", *order)) - 1
    return d.join(base, AT).withColumn("_i", F.col("_base") + own).drop("_key", "_t", "_block", "_base")


def filled(df: DataFrame, key: str | Sequence[str], time: str, value: str | Column, name: str, block_us: int = DAY) -> DataFrame:
    """`df` with the last value that isn't null up to each row of its series."""
    d = placed(df, key, time, block_us).withColumn("_v", value if isinstance(value, Column) else F.col(value))
    lasts = d.groupBy(*AT).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_last"))
    carried = lasts.select(*AT, F.last("_last", ignorenulls=True).over(_chain().rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy(*AT).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    return d.join(carried, AT).withColumn(name, F.coalesce(own, "_carried")).drop("_key", "_t", "_block", "_v", "_carried")


def runs(df: DataFrame, key: str | Sequence[str], time: str, label: str, max_gap: Column | int | None = None, block_us: int = DAY, name: str = "run") -> DataFrame:
    """`df` with `name`: a number per series, from 1 on, that grows where the label changes or a gap is longer than `max_gap` microseconds.

    A block's summary is its first and last label and time and the number of changes inside; chained, the summaries tell whether a
    block's first row begins a run and how many began before. `max_gap` may be an expression of a row's columns.
    """
    d = placed(df, key, time, block_us).withColumns({"_row": F.struct(F.col("_t"), F.col(label).alias("l")), "_gap": F.lit(None).cast("double") if max_gap is None else F.lit(max_gap) if isinstance(max_gap, int) else max_gap})
    new = lambda row, last, gap: ~row["l"].eqNullSafe(last["l"]) | F.coalesce((row["_t"] - last["_t"]) > gap, F.lit(False))
    inside = Window.partitionBy(*AT).orderBy("_row")
    prev = F.lag("_row").over(inside)
    d = d.withColumn("_new", F.when(prev.isNotNull() & new(F.col("_row"), prev, F.col("_gap")), 1).otherwise(0))
    ends = d.groupBy(*AT).agg(F.min(F.struct("_row", "_gap")).alias("_first"), F.max("_row").alias("_last"), F.sum("_new").alias("_changes"))
    ahead = F.lag("_last").over(_chain())
    begins = ends.withColumn("_begins", F.when(ahead.isNull() | new(F.col("_first._row"), ahead, F.col("_first._gap")), 1).otherwise(0))
    base = begins.select(*AT, (_so_far(F.col("_begins") + F.col("_changes")) + F.col("_begins")).alias("_base"))
    own = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return d.join(base, AT).withColumn(name, F.col("_base") + own).drop("_key", "_t", "_block", "_row", "_gap", "_new", "_base")


def rolling(df: DataFrame, key: str | Sequence[str], time: str, value: str, back_us: int, ahead_us: int, block_us: int = DAY) -> DataFrame:
    """`df` with _sum and _count of `value` over (t - back, t + ahead] of its series.

    A window is the difference of two running sums, each of which a task makes in one pass, so the work grows with the rows
    and not with those of a window. Rows near a block's ends are lent to the blocks beside it; a block is at least eight windows
    long, so few are. What is not finite is counted apart: it shows in its own windows only. Sums are as exact as
    doubles of the size of a block's sum.
    """
    wide = max(block_us, 8 * max(back_us, ahead_us))
    v = F.col(value).cast("double")
    d = placed(df, key, time, wide).withColumns({"_v": v, "_lent": F.lit(False)})
    off = F.pmod(F.col("_t"), F.lit(wide))
    sides = F.array_compact(F.array(F.when(off <= back_us + ahead_us, F.col("_block") - 1), F.when(off >= wide - back_us - ahead_us, F.col("_block") + 1)))
    lent = d.select("_key", "_t", "_v", F.explode(sides).alias("_block"), F.lit(True).alias("_lent")).where(F.col("_v").isNotNull())
    both = d.unionByName(lent, allowMissingColumns=True)
    w = Window.partitionBy(*AT).orderBy("_t")
    within = lambda c: F.coalesce(F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, ahead_us)), F.lit(0)) - F.coalesce(F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, -back_us)), F.lit(0))
    inf = F.lit(float("inf"))
    odd = {"_nan": F.isnan("_v"), "_up": F.col("_v") == inf, "_down": F.col("_v") == -inf}
    fine = ~F.isnan("_v") & (F.abs("_v") < inf)
    summed = both.withColumns({"_sum": within(F.when(fine, F.col("_v"))), "_count": within(F.col("_v").isNotNull().cast("long")), **{n: within(F.coalesce(c, F.lit(False)).cast("long")) for n, c in odd.items()}})
    bad = F.when((F.col("_nan") > 0) | ((F.col("_up") > 0) & (F.col("_down") > 0)), F.lit(float("nan"))).when(F.col("_up") > 0, inf).when(F.col("_down") > 0, -inf)
    return summed.where("NOT _lent").withColumn("_sum", F.coalesce(bad, "_sum")).drop("_key", "_t", "_block", "_v", "_lent", *odd)
