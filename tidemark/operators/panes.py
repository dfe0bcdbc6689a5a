"""Sliding windows by panes: each row is counted once, in its hour, and a window is the sum of its hours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import HOUR, micros

NAMES = ("n", "abs", "sum")


def pane_end(time: str | Column, pane_us: int = HOUR) -> Column:
    """The end of the pane (end - width, end] of a time, in microseconds."""
    t = micros(time)
    return t + F.pmod(-t, F.lit(pane_us))


def slid(panes: DataFrame, end: str, sums: Sequence[str], keys: Sequence[str] = (), width: int = 24, pane_us: int = HOUR) -> DataFrame:
    """keys, `end` and the `sums` over the last `width` panes, at each pane in which a window has rows.

    `panes` has a row a pane and key. A pane is told to the next pane of its key, or for a window if there is none, so panes
    without rows get theirs; the frames are over panes, of which a key has as many as hours, whatever the number of rows.
    """
    keys = list(keys)
    along = Window.partitionBy(*keys).orderBy(end)
    last = F.least(F.coalesce(F.lead(end).over(along), F.col(end) + width * pane_us), F.col(end) + width * pane_us) - pane_us
    full = panes.withColumn("_last", last).withColumn("_at", F.explode(F.sequence(F.col(end), F.col("_last"), F.lit(pane_us))))
    own = full.select(*keys, F.col("_at").alias(end), *[F.when(F.col("_at") == F.col(end), F.col(c)).otherwise(0).alias(c) for c in sums])
    frame = along.rangeBetween(-(width - 1) * pane_us, 0)
    return own.select(*keys, end, *[F.sum(c).over(frame).alias(c) for c in sums])


def trailing_counts(df: DataFrame, time: str, keys: Sequence[str], counts: Mapping[str, Column], width: int = 24, pane_us: int = HOUR) -> DataFrame:
    """keys, now and, for each pane end, how many rows of (now - width, now] meet each condition."""
    panes = df.groupBy(*keys, pane_end(time, pane_us).alias("_end")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return slid(panes, "_end", list(counts), keys, width, pane_us).select(*keys, F.timestamp_micros("_end").cast("timestamp_ntz").alias("now"), *counts)


def trailing_errors(df: DataFrame, valid: str, group: Sequence[str], issue: str, error: str, width: int = 24) -> DataFrame:
    """now, n, mae, bias of the errors valid in (now - width hours, now], for each hour in which there are any.

    Of the rows of one `group` that are valid in the same clock hour only the latest issue in the window counts. A clock hour
    has its first instant in one pane and the rest in the next; so a group's hour gives at most two rows, the latest of each
    pane, and the later of both counts wherever both are in the window. A group counts in the first pane's windows with that one,
    and two corrections, at the window in which only the first pane is and at the one in which only the second still is, mend the
    rest: no row is copied for its windows.
    """
    end, hour = pane_end(valid), F.date_trunc("hour", valid)
    best = df.groupBy(*group, hour.alias("_hour"), end.alias("_end")).agg(F.max_by(error, issue).alias("_e"), F.max(issue).alias("_issue"))
    w = Window.partitionBy(*group, "_hour").orderBy("_end")
    seen = best.withColumns({"_later": F.lead(F.struct("_issue", "_e", "_end")).over(w), "_first": F.row_number().over(w) == 1}).where("_first")
    both = F.col("_later").isNotNull()
    chosen = F.when(both & (F.col("_later._issue") > F.col("_issue")), F.col("_later._e")).otherwise(F.col("_e"))
    e = seen.select("_end", both.alias("_both"), F.col("_e").alias("_early"), F.col("_later._e").alias("_late"), chosen.alias("_e"))
    of = lambda c: {"n": F.lit(1).cast("long"), "abs": F.abs(c), "sum": c}
    add = lambda parts: [F.sum(c).alias(n) for n, c in parts.items()]
    panes = e.groupBy("_end").agg(*add(of(F.col("_e"))))
    early, late, now = of(F.col("_early")), of(F.col("_late")), of(F.col("_e"))
    mends = F.array(F.struct(F.col("_end").alias("_end"), *[(early[k] - now[k]).alias(k) for k in NAMES]), F.struct((F.col("_end") + width * HOUR).alias("_end"), *[late[k].alias(k) for k in NAMES]))
    fixes = e.where("_both").select(F.explode(mends).alias("m")).select("m.*").groupBy("_end").agg(*[F.sum(k).alias(f"_{k}") for k in NAMES])
    whole = slid(panes, "_end", NAMES, (), width).join(fixes, "_end", "full")
    n, a, s = (F.coalesce(k, F.lit(0)) + F.coalesce(f"_{k}", F.lit(0)) for k in NAMES)
    return whole.select(F.timestamp_micros("_end").cast("timestamp_ntz").alias("now"), n.alias("n"), (a / n).alias("mae"), (s / n).alias("bias")).where("n > 0")
