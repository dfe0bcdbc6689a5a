"""Ordered-series operators. Windows are always partitioned by the series key, and by day where the operator restarts daily."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY, HOUR, SECOND, micros
from ..sources.scratch import table
from . import blocks
from .quantiles import quantiles


def ordered(key: str | Sequence[str], time: str = "time"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(time)


def running(key: str | Sequence[str], time: str = "time"):
    return ordered(key, time).rowsBetween(Window.unboundedPreceding, 0)


def counter_delta(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """`total`: what a counter has gained since its day began; resets count as nothing, null rows stay null."""
    d = df.withColumn("day", F.to_date(time))
    prev = F.last(value, ignorenulls=True).over(Window.partitionBy(key, "day").orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    gain = F.when(F.col(value).isNotNull(), F.coalesce(F.greatest(F.col(value) - prev, F.lit(0)), F.lit(0)))
    return d.withColumn("_gain", gain).withColumn("total", F.when(F.col(value).isNotNull(), F.sum("_gain").over(running([key, "day"], time)))).drop("_gain")


def trapezoid_energy(df: DataFrame, key: str, time: str, power: Column) -> DataFrame:
    """`kwh`: energy of the day so far by trapezoids, 0 at the day's first sample."""
    d = df.withColumns({"day": F.to_date(time), "_p": power})
    w = Window.partitionBy(key, "day").orderBy(time)
    part = F.coalesce((F.col("_p") + F.lag("_p").over(w)) / 2 * (micros(time) - F.lag(micros(time)).over(w)) / HOUR / 1000, F.lit(0.0))
    return d.withColumn("_e", part).withColumn("kwh", F.sum("_e").over(running([key, "day"], time))).drop("_p", "_e")


def rate(df: DataFrame, key: str | Sequence[str], time: str, value: str) -> DataFrame:
    """`rate`: gain per second of an accumulated value, not below 0; null at the first sample."""
    w = ordered(key, time)
    return df.withColumn("rate", F.greatest(F.lit(0.0), (F.col(value) - F.lag(value).over(w)) / ((micros(time) - F.lag(micros(time)).over(w)) / SECOND)))


def steps(df: DataFrame, key: str, time: str, block_us: int = DAY) -> DataFrame:
    """`df` with _back: microseconds since the row before in its series, null for the first."""
    return blocks.before(df, key, time, block_us=block_us).withColumn("_back", micros(time) - F.col("_before._t")).drop("_before")


def cadence(steps: DataFrame, key: str) -> DataFrame:
    """key, cadence: the median positive step, whole microseconds, of rows with _back (see steps)."""
    return quantiles(steps.where("_back > 0"), [key], "_back", [0.5]).select(key, F.col("q")[0].cast("long").alias("cadence"))


def gap_markers(df: DataFrame, key: str, time: str, factor: float = 3.5, least: int = 60 * SECOND) -> DataFrame:
    """key, time_us of the rows that break a line at gaps longer than max(factor * cadence, least).

    A gap gets a row a pad after its start and before its end, or one at its middle if the two would cross; the pad
    is the cadence, a third of the gap at most.
    """
    own = table(steps(df.select(key, time), key, time).select(key, (micros(time) - F.col("_back")).alias("_t"), "_back"), "steps")
    gaps = own.join(cadence(own, key), key).where(F.col("_back") > F.greatest(F.floor(F.col("cadence") * factor), F.lit(least)))
    pad = F.least(F.col("cadence"), F.greatest(F.lit(1), F.expr("_back div 3")))
    a, b = F.col("_t") + pad, F.col("_t") + F.col("_back") - pad
    return gaps.select(key, F.explode(F.when(a < b, F.array(a, b)).otherwise(F.array(F.col("_t") + F.expr("_back div 2")))).alias("time_us"))


def segments(df: DataFrame, key: str, time: str, factor: float = 4.0, least: int = 300 * SECOND) -> DataFrame:
    """`segment`: a number that grows by 1 at each gap longer than max(factor * cadence, least)."""
    own = table(steps(df, key, time), "steps")
    flag = F.when(F.col("_back") > F.greatest(F.col("cadence") * factor, F.lit(least)), 1).otherwise(0)
    return blocks.running_sum(own.join(cadence(own, key), key, "left"), key, time, flag, "segment").drop("_back", "cadence")


def rolling_mean(df: DataFrame, key: str, time: str, value: str, minutes: int = 30) -> DataFrame:
    """`mean` over (t - half, t + half], at least one value; see blocks.rolling."""
    half = minutes * 30 * SECOND
    return blocks.rolling(df, key, time, value, half, half).withColumn("mean", F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count"))).drop("_sum", "_count")


def islands(df: DataFrame, key: str, time: str, label: str, max_gap: Column | int | None = None) -> DataFrame:
    """`run`: a number per key that grows where the label changes or a gap is longer than `max_gap` microseconds."""
    return blocks.runs(df, key, time, label, max_gap)


def _sampled(rows: DataFrame, samples: DataFrame, key: str, time: str, value: str, block_us: int, after: bool = True) -> DataFrame:
    """`rows` with `_t` and the samples that surround them: `_b`, the last not after, and `_n`, the first not before (structs t, v).

    Series are cut into blocks of time, so that a long one is many tasks; the last and first samples of the blocks, a
    row a block, are carried over to the others. Both windows run from an end of the block up to the row, the second
    one backwards in time, so that the work grows with the rows. Nothing is multiplied. Of samples that share a time,
    which there should not be, one is taken.
    """
    one = rows.withColumns({"_left": F.lit(True), "_s": F.lit(None).cast("struct<t:bigint,v:double>")})
    two = samples.where(F.col(value).isNotNull()).select(key, time, F.lit(False).alias("_left"), F.struct(micros(time).alias("t"), F.col(value).cast("double").alias("v")).alias("_s"))
    both = one.unionByName(two, allowMissingColumns=True).withColumn("_t", micros(time)).withColumn("_block", F.expr(f"_t div {block_us}"))
    ends = both.groupBy(key, "_block").agg(F.max("_s").alias("_last"), F.min("_s").alias("_first"))
    along = Window.partitionBy(key).orderBy("_block")
    carried = ends.withColumns({
        "_before": F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.last("_first", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)),
    }).select(F.col(key).alias("_key"), F.col("_block").alias("_at"), "_before", "_after")
    placed = both.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    inside = Window.partitionBy(key, "_block")
    seen = placed.withColumn("_b", F.coalesce(F.last("_s", ignorenulls=True).over(inside.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)), "_before"))
    if after:
        seen = seen.withColumn("_n", F.coalesce(F.last("_s", ignorenulls=True).over(inside.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0)), "_after"))
    return seen.where("_left")


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tolerance_us: int | None = None, how: str = "nearest", block_us: int = DAY) -> DataFrame:
    """`left` with the value and time of a sample of `right`: nearest (a tie takes the later), or the latest not after.

    Beyond the tolerance, which counts, the value is null. See _sampled for how rows find their samples.
    """
    cols = left.columns
    seen = _sampled(left, right, key, time, value, block_us, how != "backward")
    if how == "backward":
        seen = seen.withColumn("_pick", F.col("_b"))
    else:
        later = F.col("_b").isNull() | ((F.col("_n.t") - F.col("_t")) <= (F.col("_t") - F.col("_b.t")))
        seen = seen.withColumn("_pick", F.when(F.col("_n").isNotNull() & later, F.col("_n")).otherwise(F.col("_b")))
    near = F.lit(True) if tolerance_us is None else F.abs(F.col("_pick.t") - F.col("_t")) <= tolerance_us
    return seen.select(*cols, F.when(near, F.col("_pick.v")).alias(f"{value}_match"), F.when(near, F.col("_pick.t")).alias("match_us"))


def interpolate(grid: DataFrame, samples: DataFrame, key: str, time: str, value: str, block_us: int = DAY) -> DataFrame:
    """`grid` with `value` linear in time between samples, and the nearest sample beyond their ends."""
    seen = _sampled(grid.select(key, time), samples, key, time, value, block_us)
    share = (F.col("_t") - F.col("_b.t")) / (F.col("_n.t") - F.col("_b.t"))
    v = F.when(F.col("_b").isNull(), F.col("_n.v")).when(F.col("_n").isNull() | (F.col("_n.t") == F.col("_b.t")), F.col("_b.v")).otherwise(F.col("_b.v") + share * (F.col("_n.v") - F.col("_b.v")))
    return seen.select(key, time, v.alias(value))


def even_pick(df: DataFrame, key: str, time: str, most: Column | int, order: Sequence[str] = ()) -> DataFrame:
    """`most` rows of each series at the floors of even steps from its first to its last, all if there are no more; `most` may be a column, the same in a series."""
    k = F.lit(most).cast("long") if isinstance(most, int) else most
    r = blocks.numbered(df.withColumn("_k", k), key, time, order)
    # i is picked if some j < k has floor(j (n - 1) / (k - 1)) = i
    picked = F.expr("((_i * (_k - 1) + _n - 2) div greatest(_n - 1, 1)) * (_n - 1) div greatest(_k - 1, 1) = _i")
    return r.where((F.col("_n") <= F.col("_k")) | ((F.col("_k") > 0) & ((F.col("_i") == 0) | ((F.col("_k") > 1) & picked)))).drop("_k", "_i", "_n")


def stride(df: DataFrame, key: str, time: str, most: int) -> DataFrame:
    """Every so manieth row of each series, from its first on, so that `most` at most are left."""
    return blocks.numbered(df, key, time).where(f"_i % greatest(1, (_n + {most - 1}) div {most}) = 0").drop("_i", "_n")


def downsample(df: DataFrame, key: str, time: str, value: str, budget: Column | int) -> DataFrame:
    """Rows of each series that keep its ends and every bucket's extremes, `budget` at most, at least 2; it may be a column, the same in a series.

    (budget - 2) // 2 buckets, or one, of consecutive rows; in each the first least and the first greatest value stay, found by
    aggregation, null and NaN left out. What is then too many for a budget under 4 is picked evenly.
    """
    k = F.lit(budget).cast("long") if isinstance(budget, int) else budget
    cols = df.columns
    r = blocks.numbered(df.withColumn("_k", F.greatest(k, F.lit(2).cast("long"))), key, time, [value]).withColumn("_own", F.struct("_i", *cols))
    few, many = r.where("_n <= _k"), r.where("_n > _k")
    # bucket b holds the rows i with floor(b n / k) <= i < floor((b + 1) n / k)
    bucket = F.expr("((_i + 1) * greatest(1, (_k - 2) div 2) - 1) div _n").alias("_b")
    valued = many.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    found = valued.groupBy(key, bucket).agg(F.first("_k").alias("_k"), F.min_by("_own", F.struct(F.col(value), F.col("_i"))).alias("_low"), F.max_by("_own", F.struct(F.col(value), -F.col("_i"))).alias("_high"))
    ends = many.where("_i = 0 OR _i = _n - 1").select("_k", "_own")
    kept = ends.unionByName(found.select("_k", F.explode(F.array("_low", "_high")).alias("_own"))).distinct()
    picked = even_pick(kept.where("_k < 4").select("_k", "_own.*"), key, time, F.col("_k"), ["_i"])
    return few.select(*cols).unionByName(kept.where("_k >= 4").select("_own.*").select(*cols)).unionByName(picked.select(*cols))


def gapped(df: DataFrame, key: str, time: str, value: str, budget: int, markers: DataFrame | None = None) -> DataFrame:
    """key, time_us, value: `budget` rows a series at most, of which those without a value break the line at gaps.

    Of the markers (gap_markers, or key and time_us of others) budget - 2 at most stay, picked evenly; the rest of the budget is
    for values, of which 2 stay in any case. Rows of `df` without a value are markers too.
    """
    told = gap_markers(df, key, time) if markers is None else markers
    none = df.where(F.col(value).isNull()).select(key, micros(time).alias("time_us"))
    at = told.select(key, "time_us").unionByName(none).distinct().withColumn("_at", F.timestamp_micros("time_us"))
    kept = even_pick(at, key, "_at", max(0, budget - 2)).select(key, "time_us")
    counts = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_g"))
    values = df.where(F.col(value).isNotNull()).select(key, time, value).join(counts, key, "left").withColumn("_left", F.greatest(F.lit(2), F.lit(budget) - F.coalesce("_g", F.lit(0))).cast("long"))
    thin = downsample(values.drop("_g"), key, time, value, F.col("_left")).select(key, micros(time).alias("time_us"), value)
    return thin.unionByName(kept, allowMissingColumns=True)


def bounded_balance(df: DataFrame, key: str | Sequence[str], time: str, delta: str, start: float, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """`balance`: x = min(high, max(low, x + delta)) from `start`, in order of time.

    The fold is over one array per key, which suits forecast horizons of some thousand steps; balance_by_block takes
    longer series.
    """
    keys = [key] if isinstance(key, str) else list(key)
    steps = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.coalesce(F.col(delta), F.lit(0.0)).alias("d")))).alias("s"))
    zero = F.struct(F.array().cast("array<double>").alias("xs"), F.lit(float(start)).alias("x"))
    clip = lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x))
    fold = F.aggregate("s", zero, lambda acc, e: F.struct(F.concat(acc["xs"], F.array(clip(acc["x"] + e["d"]))).alias("xs"), clip(acc["x"] + e["d"]).alias("x")), lambda acc: acc["xs"])
    return steps.withColumn("x", fold).select(*keys, F.explode(F.arrays_zip("s", "x")).alias("z")).select(*keys, F.col("z.s.t").alias(time), F.col("z.x").alias("balance"))


def _block_maps(df: DataFrame, key: str, time: str, delta: str, block: Column, low: float, high: float) -> DataFrame:
    """key, _block, s (the block's steps in order) and m: the map x -> min(m.h, max(m.l, x + m.a)) that they are together."""
    clip = lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x))
    parts = df.withColumn("_block", block).groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.coalesce(F.col(delta), F.lit(0.0)).alias("d")))).alias("s"))
    ident = F.struct(F.lit(0.0).alias("a"), F.lit(float(low)).alias("l"), F.lit(float(high)).alias("h"))
    step = lambda m, e: F.struct((m["a"] + e["d"]).alias("a"), clip(m["l"] + e["d"]).alias("l"), clip(m["h"] + e["d"]).alias("h"))
    return parts.withColumn("m", F.aggregate("s", ident, step))


def _listed(maps: DataFrame, key: str) -> DataFrame:
    """key, ms: the blocks' maps in order, one small struct a block."""
    return maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_block").alias("b"), F.col("m")))).alias("ms"))


def last_balance(df: DataFrame, key: str, time: str, delta: str, block: Column, start: float, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """key, balance: where bounded_balance ends; long series are folded block by block."""
    after = F.aggregate("ms", F.lit(float(start)), lambda x, e: F.least(e["m"]["h"], F.greatest(e["m"]["l"], x + e["m"]["a"])))
    return _listed(_block_maps(df, key, time, delta, block, low, high), key).select(key, after.alias("balance"))


def ewma(df: DataFrame, key: str, time: str, value: str, weight) -> DataFrame:
    """key, ewma: x += weight(n) * (v - x) from the first value on, n counting from 1, `weight` a function of columns below 1.

    What is left of a value at the end is a product over the steps behind it, which running sums of logarithms give: a
    window and a sum, however long the series.
    """
    w = Window.partitionBy(key).orderBy(time)
    n = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w))
    a = n.withColumn("_w", weight(F.col("_n"))).withColumn("_s", F.sum(F.when(F.col("_n") > 1, F.log(1 - F.col("_w"))).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.exp(F.min("_s").over(Window.partitionBy(key)) - F.col("_s"))
    share = F.when(F.col("_n") == 1, left).otherwise(F.col("_w") * left)
    return a.withColumn("_p", share * F.col(value)).groupBy(key).agg(F.sum("_p").alias("ewma"))


def balance_by_block(df: DataFrame, key: str, time: str, delta: str, block: Column, start: float, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """bounded_balance of long series: blocks (days, say) are folded to one map each, the maps give each block its start.

    A step is the map x -> min(h, max(l, x + a)), and such maps compose to one of their kind. The fold over blocks is
    over one short array per key; inside, every block is folded alone.
    """
    clip = lambda x, a, b: F.least(b, F.greatest(a, x))
    maps = _block_maps(df, key, time, delta, block, low, high)
    listed = _listed(maps, key)
    first = F.struct(F.array().cast("array<double>").alias("xs"), F.lit(float(start)).alias("x"))
    along = F.aggregate("ms", first, lambda acc, e: F.struct(F.concat(acc["xs"], F.array(acc["x"])).alias("xs"), F.least(e["m"]["h"], F.greatest(e["m"]["l"], acc["x"] + e["m"]["a"])).alias("x")), lambda acc: acc["xs"])
    starts = listed.withColumn("x0", along).select(key, F.explode(F.arrays_zip("ms", "x0")).alias("z")).select(key, F.col("z.ms.b").alias("_block"), F.col("z.x0").alias("_x0"))
    placed = maps.join(starts, [key, "_block"])
    zero = F.struct(F.array().cast("array<double>").alias("xs"), F.col("_x0").alias("x"))
    fold = F.aggregate("s", zero, lambda acc, e: F.struct(F.concat(acc["xs"], F.array(clip(acc["x"] + e["d"], F.lit(low), F.lit(high)))).alias("xs"), clip(acc["x"] + e["d"], F.lit(low), F.lit(high)).alias("x")), lambda acc: acc["xs"])
    return placed.withColumn("x", fold).select(key, F.explode(F.arrays_zip("s", "x")).alias("z")).select(key, F.col("z.s.t").alias(time), F.col("z.x").alias("balance"))


def day_breaks(df: DataFrame, key: str | Sequence[str], time: str) -> DataFrame:
    """key, time: the midnights that begin the day of a row whose predecessor is of another day."""
    keys = [key] if isinstance(key, str) else list(key)
    s = blocks.before(df.select(*keys, time), keys, time)
    day = F.date_trunc("day", time).cast("timestamp_ntz")
    return s.where(micros(day) > F.col("_before._t")).select(*keys, day.alias(time))


def plot_trace(df: DataFrame, key: str, time: str, value: str, low: float, high: float, horizon_us: int, smooth_minutes: int, budget: int) -> DataFrame:
    """key, time_us, value of a line to draw: in range, up to a horizon from the first value, smoothed, `budget` rows a series with gap markers, with nulls at midnights besides.

    A midnight breaks the line between the values that stay; these rows come on top of the budget, a day at most one.
    """
    clean = df.where(F.col(value).between(low, high)).select(key, time, value)
    first = clean.groupBy(key).agg(F.min(micros(time)).alias("_a"))
    seen = clean.join(first, key).where(micros(time) <= F.col("_a") + horizon_us).drop("_a")
    smooth = table(rolling_mean(seen, key, time, value, smooth_minutes).select(key, time, F.round("mean", 9).alias(value)), "smooth")
    lines = table(gapped(smooth, key, time, value, budget), "lines")
    drawn = lines.where(F.col(value).isNotNull()).select(key, F.timestamp_micros("time_us").cast("timestamp_ntz").alias(time))
    breaks = day_breaks(drawn, key, time).select(key, micros(time).alias("time_us"))
    return lines.unionByName(breaks.join(lines.where(F.col(value).isNull()), [key, "time_us"], "left_anti"), allowMissingColumns=True)
