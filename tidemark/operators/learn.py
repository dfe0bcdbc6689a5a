"""What a station teaches about itself: boundaries, thresholds, regimes, battery parameters, profiles and projections.

Every function takes names of columns and thresholds as parameters and groups by the keys that it is given.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import HOUR, MINUTE, bucket, micros
from ..sources.scratch import table
from . import series as so
from .gaps import widest_gap
from .quantiles import quantiles
from .stats import robust_kept, robust_scale


def list_median(c: Column) -> Column:
    """Median of a short array, null of an empty one."""
    s = F.array_sort(c)
    at = lambda i: F.get(s, F.floor(i).cast("int"))
    return (at((F.size(c) - 1) / 2) + at(F.size(c) / 2)) / 2


def list_scale(c: Column, middle: Column, floor: float = 3.0) -> Column:
    """1.4826 times the median distance of a short array from its median, at least `floor`."""
    return F.greatest(F.lit(floor), 1.4826 * list_median(F.transform(c, lambda x: F.abs(x - middle))))


def material(a: Column, b: Column, scale_a: Column, scale_b: Column, least: float = 20.0, relative: float = 0.08) -> Column:
    """Whether two medians differ by more than a fixed bound, a share of the lower one and three times the larger scale."""
    return F.abs(a - b) >= F.greatest(F.lit(least), relative * F.greatest(F.least(a, b), F.lit(1.0)), 3.0 * F.greatest(scale_a, scale_b))


def startup_boundary(runs: DataFrame, keys: Sequence[str], time: str, value: str, cadence_minutes: Column | float, minimum: int = 4, limit_minutes: float = 720.0, least: float = 20.0, relative: float = 0.08) -> DataFrame:
    """keys, boundary, change: of each run the first settled sample's number, 0 where no startup shows.

    Values are smoothed by a centred median of three. A boundary has a material change (see `material`) between the
    `minimum` samples before and after, and lies within `limit_minutes` of the start; the strongest counts, then the
    first. Runs shorter than three times `minimum` have none.
    """
    w, every = Window.partitionBy(*keys).orderBy(time), Window.partitionBy(*keys)
    cadence = cadence_minutes if isinstance(cadence_minutes, Column) else F.lit(float(cadence_minutes))
    s = runs.select(*keys, time, cadence.alias("_c"), F.col(value).cast("double").alias("_x")).withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(every), "_v": list_median(F.collect_list("_x").over(w.rowsBetween(-1, 1)))})
    m = s.withColumns({"_b": F.collect_list("_v").over(w.rowsBetween(-minimum, -1)), "_a": F.collect_list("_v").over(w.rowsBetween(0, minimum - 1))})
    m = m.withColumns({"_mb": list_median(F.col("_b")), "_ma": list_median(F.col("_a"))}).withColumns({"_sb": list_scale(F.col("_b"), F.col("_mb")), "_sa": list_scale(F.col("_a"), F.col("_ma"))})
    inside = (F.col("_n") >= 3 * minimum) & (F.col("_i") >= minimum) & (F.col("_i") <= F.least(F.col("_n") - minimum, F.floor(limit_minutes / F.greatest(F.col("_c"), F.lit(1.0)))))
    change = F.abs(F.col("_mb") - F.col("_ma"))
    ok = inside & material(F.col("_mb"), F.col("_ma"), F.col("_sb"), F.col("_sa"), least, relative)
    best = F.max(F.when(ok, F.struct(change.alias("d"), (-F.col("_i")).alias("i"))))
    return m.groupBy(*keys).agg(best.alias("_g")).select(*keys, F.coalesce(-F.col("_g.i"), F.lit(0)).cast("int").alias("boundary"), F.col("_g.d").alias("change"))


def log_gap_threshold(df: DataFrame, key: str, value: str, least: int = 20, ratio: float = 3.0) -> DataFrame:
    """key, threshold: the middle, in log(1 + x), of the widest such gap between the distinct values from P10 to P90.

    Null with fewer than `least` values from 0 up, or where the gap's ends don't differ by the ratio.
    """
    v = df.where(F.col(value) >= 0).select(key, F.col(value).cast("double").alias("_v"))
    q = table(quantiles(v, [key], "_v", [0.1, 0.9]), "ranges")
    inside = v.join(q.where(F.col("n") >= least), key).where(F.col("_v").between(F.col("q")[0], F.col("q")[1])).select(key, "_v").distinct()
    best = widest_gap(inside, [key], "_v", F.log1p)
    cut = F.when((F.col("high") + 1) / (F.col("low") + 1) >= ratio, F.expm1((F.log1p("low") + F.log1p("high")) / 2))
    return q.select(key).join(best, key, "left").select(key, cut.alias("threshold"))


def spaced_registry(df: DataFrame, key: str, time: str, value: str, interval_us: int, keep: int = 168) -> DataFrame:
    """key, n, level, latest: the median of the newest `keep` observations that stand apart.

    An observation within the interval of the one before replaces it, so of a chain of such the last stands.
    """
    w = Window.partitionBy(key).orderBy(time)
    ahead = F.lead(micros(time)).over(w) - micros(time)
    stood = df.withColumn("_d", ahead).where(F.col("_d").isNull() | (F.col("_d") >= interval_us))
    kept = stood.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))).where(F.col("_rn") <= keep)
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("level"), F.max_by(value, time).alias("latest"))


def intervals(df: DataFrame, key: str, time: str, label: str, idle: str | None = None, fallback_us: int = HOUR) -> DataFrame:
    """key, start, stop, label, n of each run of a label but `idle` and null ones.

    A run ends where the next starts, the last a median step after its last sample, or `fallback_us` without a step.
    """
    w = Window.partitionBy(key).orderBy(time)
    steps = df.select(key, (micros(time) - F.lag(micros(time)).over(w)).alias("_d")).where("_d > 0").groupBy(key).agg(F.floor(F.median("_d")).alias("_step"))
    runs = so.islands(df.select(key, time, label), key, time, label).groupBy(key, "run", label).agg(F.min(time).alias("start"), F.max(time).alias("_end"), F.count(F.lit(1)).alias("n"))
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    told = runs.withColumn("_next", after).join(steps, key, "left")
    stop = F.coalesce(F.col("_next"), F.timestamp_micros(micros("_end") + F.coalesce("_step", F.lit(fallback_us))).cast("timestamp_ntz"))
    said = F.col(label).isNotNull() if idle is None else F.col(label).isNotNull() & (F.col(label) != idle)
    return told.where(said).select(key, "start", stop.alias("stop"), label, "n")


def energy_display(df: DataFrame, key: str, time: str, counters: Sequence[str], powers: Sequence[str], minutes: int) -> DataFrame:
    """key, time (buckets of some minutes), a gain per counter, generated, used_kwh: the bucket's last values, rows without any dropped.

    Counters count since the day began and may be reset (see series.counter_delta); generated is the sum of those that
    are there. Power is the sum of those that are there, not below 0, and its energy is that of the day so far.
    """
    d, gains = df, []
    for c in counters:
        d = so.counter_delta(d, key, time, c).withColumnRenamed("total", f"{c}_gain").drop("day")
        gains.append(f"{c}_gain")
    some = lambda cols: F.coalesce(*[F.col(c) for c in cols]).isNotNull()
    total = lambda cols: sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0))
    made = d.select(key, time, *gains, F.when(some(gains), total(gains)).alias("generated"))
    drawn = so.trapezoid_energy(df.where(some(powers)), key, time, F.greatest(F.lit(0.0), total(powers))).select(key, time, F.col("kwh").alias("used_kwh"))
    both = made.unionByName(drawn, allowMissingColumns=True)
    names = [*gains, "generated", "used_kwh"]
    last = both.groupBy(key, bucket(time, minutes).alias("_b")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in names])
    return last.where(some(names)).select(key, F.col("_b").alias(time), *names)


def regimes(df: DataFrame, key: str, value: str, minimum: int = 4, least_gap: float = 20.0) -> DataFrame:
    """key, regime (0 low, 1 high), location, scale, weight, n, and the mixture's mean and variance.

    The values are cut at their widest gap, the first of several, if that is at least `least_gap` and three times the
    sides' common scale and if each side has `minimum` values; else they are one regime, of the values near their median.
    Equal values of a key are one row with their number from the start; null and NaN don't count.
    """
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(key, F.col(value).cast("double").alias("_v"))
    v = table(v.agg(F.count(F.lit(1)).alias("_w")), "values")
    cut = widest_gap(v, [key], "_v").select(key, F.when(F.col("gap") > 0, F.col("low")).alias("_low"), F.col("gap").alias("_gap"))
    sided = v.join(cut, key).withColumn("regime", F.coalesce((F.col("_v") > F.col("_low")).cast("int"), F.lit(0)))
    sided = table(sided, "sides")
    sizes = sided.groupBy(key, "regime").agg(F.sum("_w").alias("_size"), F.max("_gap").alias("_gap"))
    sizes = sizes.withColumn("_all", F.sum("_size").over(Window.partitionBy(key)))
    sides = table(robust_scale(sided, [key, "regime"], "_v", weight="_w").join(sizes, [key, "regime"]), "regimes")
    test = sides.groupBy(key).agg(F.count(F.lit(1)).alias("_sides"), F.min("_size").alias("_few"), F.max("_gap").alias("_gap"), F.sqrt(F.sum(F.col("scale") * F.col("scale"))).alias("_noise"))
    two = (F.col("_sides") == 2) & (F.col("_few") >= minimum) & (F.col("_gap") >= F.greatest(F.lit(least_gap), 3.0 * F.col("_noise")))
    split = test.select(key, F.coalesce(two, F.lit(False)).alias("_two"))
    apart = sides.join(split.where("_two"), key).select(key, "regime", F.col("median").alias("location"), "scale", (F.col("n") / F.col("_all")).alias("weight"), "n")
    near = table(robust_kept(sided.join(split.where("NOT _two"), key).select(key, "_v", "_w"), [key], "_v", weight="_w"), "near")
    whole = near.groupBy(key).agg(F.sum("_w").alias("_near"))
    one = robust_scale(near, [key], "_v", weight="_w").join(whole, key).select(key, F.lit(0).alias("regime"), F.col("median").alias("location"), "scale", (F.col("n") / F.col("_near")).alias("weight"), "n")
    w = Window.partitionBy(key)
    share = F.col("weight") / F.sum("weight").over(w)
    mixed = apart.union(one).withColumn("_share", share).withColumn("mean", F.sum(F.col("_share") * F.col("location")).over(w))
    spread = F.col("_share") * (F.col("scale") * F.col("scale") + (F.col("location") - F.col("mean")) * (F.col("location") - F.col("mean")))
    return mixed.withColumn("variance", F.sum(spread).over(w)).select(key, "regime", "location", "scale", "weight", "n", "mean", "variance")


def increment_profile(obs: DataFrame, base: DataFrame, tiers: DataFrame, station: str, time: str, tier: str, value: str, active: str, sample_hours: float = 0.25, gap_us: int = 30 * MINUTE, fallback: tuple[float, float] = (400.0, 1.0), reliable: tuple[int, float] = (1, 2.5)) -> DataFrame:
    """tier, p10, p50, p90, n, episodes, hours, dur_p10, dur_p50, dur_p90, duration, maturity for every row of `tiers`.

    What `active` samples of a tier lie above its base (`base`: tier, p50; none: 0), and how long their episodes last. An
    episode breaks at a sample of the station that is of another tier or not active, or at a longer gap. Tiers without a
    sample have the fallback's level and hours; a duration other than the fallback's takes reliable evidence.
    """
    w = Window.partitionBy(station).orderBy(time)
    on = F.col(active) & F.col(value).isNotNull()
    marked = obs.withColumn("_on", F.coalesce(on, F.lit(False))).withColumns({"_p": F.lag("_on").over(w), "_pt": F.lag(tier).over(w), "_d": micros(time) - F.lag(micros(time)).over(w)})
    goes_on = F.coalesce(F.col("_p") & F.col("_pt").eqNullSafe(F.col(tier)) & (F.col("_d") <= gap_us), F.lit(False))
    s = marked.where("_on").withColumn("_start", (~goes_on).cast("int")).withColumn("_ep", F.sum("_start").over(Window.partitionBy(station, tier).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))
    q = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    inc = s.join(base, tier, "left").groupBy(tier).agg(F.percentile(F.greatest(F.lit(0.0), F.col(value) - F.coalesce("p50", F.lit(0.0))), q).alias("_q"), F.count(F.lit(1)).alias("n"), F.sum("_start").alias("episodes"))
    dur = s.groupBy(tier, station, "_ep").agg((F.count(F.lit(1)) * sample_hours).alias("_h")).groupBy(tier).agg(F.percentile("_h", q).alias("_dq"))
    j = tiers.select(tier).join(inc, tier, "left").join(dur, tier, "left").join(base.select(tier, F.lit(True).alias("_based")), tier, "left")
    none, hours = F.col("n").isNull(), F.coalesce(F.col("n") * sample_hours, F.lit(0.0))
    grade = F.when(none, "estimated").when((F.col("episodes") >= reliable[0]) & (hours >= reliable[1]) & F.coalesce("_based", F.lit(False)), "reliable").otherwise("provisional")
    r = j.withColumns({"hours": hours, "maturity": grade})
    pick = lambda c, i, x: F.coalesce(F.col(c)[i], F.lit(float(x)))
    return r.select(tier, *[pick("_q", i, fallback[0]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("episodes", F.lit(0)).alias("episodes"), "hours", *[pick("_dq", i, fallback[1]).alias(n) for i, n in enumerate(("dur_p10", "dur_p50", "dur_p90"))], F.when(F.col("maturity") == "reliable", F.col("_dq")[1]).otherwise(fallback[1]).alias("duration"), "maturity")


def battery_model(df: DataFrame, key: str, time: str, soc: str, watts: str, load: str, nominal: float = 26.0, efficiency: float = 0.92, limit_w: float = 3000.0, lookback_days: int = 30) -> DataFrame:
    """key, n, capacity, charge_efficiency, discharge_efficiency, max_charge, max_discharge, confidence.

    From half-hour medians of the last days: steps of 0.25 to 1.5 h between 5 and 95 % whose charge moves by 0.2 points or
    more the way that the mean power (over 25 W) goes, under a load that moves by 100 W at most. Capacity is the median of
    those steps' between 15 and 35 kWh if there are six, else nominal; an efficiency is the median of its direction's
    within 0.65 to 1.05 if there are three. Power limits are 1.1 times the 99.5 % quantile, 100 W at least, of four or
    more raw values. With fewer than four steps the rest is as given.
    """
    end = Window.partitionBy(key)
    recent = df.withColumn("_z", F.max(time).over(end)).where(F.col(time) >= F.col("_z") - F.make_dt_interval(F.lit(lookback_days)))
    half = recent.groupBy(key, bucket(time, 30).alias("_t")).agg(F.median(soc).alias("s"), F.median(watts).alias("p"), F.median(load).alias("l")).where("s IS NOT NULL AND p IS NOT NULL")
    w = Window.partitionBy(key).orderBy("_t")
    step = half.withColumns({"s0": F.lag("s").over(w), "h": (micros("_t") - F.lag(micros("_t")).over(w)) / HOUR, "w": (F.col("p") + F.lag("p").over(w)) / 2, "dl": F.coalesce(F.abs(F.col("l") - F.lag("l").over(w)), F.lit(0.0))}).withColumn("d", F.col("s") - F.col("s0"))
    way = ((F.col("d") > 0) & (F.col("w") > 25)) | ((F.col("d") < 0) & (F.col("w") < -25))
    usable = step.where(F.col("s").between(5, 95) & F.col("s0").between(5, 95) & F.col("h").between(0.25, 1.5) & (F.abs("d") >= 0.2) & (F.col("dl") <= 100) & way).withColumn("e", F.abs("w") * F.col("h") / 1000)
    cap = F.when(F.col("d") > 0, F.col("e") * efficiency * 100 / F.abs("d")).otherwise(F.col("e") * 100 / (efficiency * F.abs("d")))
    fair = F.when(cap.between(15, 35), cap)
    sized = usable.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(fair) >= 6, F.median(fair)).otherwise(nominal).alias("capacity"))
    moved = usable.join(sized.where("n >= 4"), key).withColumn("m", F.abs("d") * F.col("capacity") / 100)
    ratio = lambda up: F.when((F.col("d") > 0) if up else (F.col("d") < 0), F.col("m") / F.col("e") if up else F.col("e") / F.col("m"))
    good = lambda r: F.when(r.between(0.65, 1.05), r)
    mean = lambda r: F.when(F.count(r) >= 3, F.median(r)).otherwise(efficiency)
    eff = moved.groupBy(key).agg(mean(good(ratio(True))).alias("ce"), mean(good(ratio(False))).alias("de"))
    power = lambda x: F.when(F.count(x) >= 4, F.greatest(F.lit(100.0), 1.1 * F.percentile(x, F.lit(0.995)))).otherwise(limit_w)
    top = recent.groupBy(key).agg(power(F.when(F.col(watts) > 0, F.col(watts))).alias("max_charge"), power(F.when(F.col(watts) < 0, -F.col(watts))).alias("max_discharge"))
    enough = half.groupBy(key).agg((F.count(F.lit(1)) >= 3).alias("_ok"))
    j = top.join(enough, key, "left").join(sized, key, "left").join(eff, key, "left")
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("_ok", F.lit(False))
    fitted = ok & (n >= 4)
    grade = F.when(fitted & (n >= 12), "calibrated").when(fitted, "provisional").otherwise("default")
    return j.select(key, F.when(fitted, n).otherwise(0).alias("n"), F.when(fitted, F.col("capacity")).otherwise(nominal).alias("capacity"), F.coalesce("ce", F.lit(efficiency)).alias("charge_efficiency"), F.coalesce("de", F.lit(efficiency)).alias("discharge_efficiency"), F.when(ok, F.col("max_charge")).otherwise(limit_w).alias("max_charge"), F.when(ok, F.col("max_discharge")).otherwise(limit_w).alias("max_discharge"), grade.alias("confidence"))


def majority_phase(rows: DataFrame, scenario: str, time: str, member: str, phase: str, mode: str) -> DataFrame:
    """scenario, time, phase, epoch: the members' most frequent phase, the least of several, and the number of times so far that any member's phase or the scenario's mode changed."""
    w = Window.partitionBy(scenario, member).orderBy(time)
    flagged = rows.withColumn("_p", F.lag(phase).over(w)).withColumn("_ch", F.coalesce(F.col("_p") != F.col(phase), F.lit(False)))
    votes = flagged.groupBy(scenario, time, phase).agg(F.count(F.lit(1)).alias("_n"), F.max("_ch").alias("_ch"), F.max(mode).alias("_mode"))
    one = votes.groupBy(scenario, time).agg(F.max(F.struct(F.col("_n").alias("n"), (-F.col(phase)).alias("p"))).alias("_g"), F.max("_ch").alias("_ch"), F.max("_mode").alias("_mode"))
    along = Window.partitionBy(scenario).orderBy(time)
    moved = F.when(F.coalesce(F.col("_ch") | (F.col("_mode") != F.lag("_mode").over(along)), F.lit(False)), 1).otherwise(0)
    return one.withColumn("_m", moved).select(scenario, time, (-F.col("_g.p")).alias(phase), F.sum("_m").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("epoch"))


def on_summary(rows: DataFrame, scenario: str, time: str, on: str) -> DataFrame:
    """scenario, starts, first_start, last_stop, on_steps (the first step isn't counted) of a switch over a scenario's steps."""
    w = Window.partitionBy(scenario).orderBy(time)
    s = rows.withColumns({"_p": F.lag(on).over(w), "_i": F.row_number().over(w)})
    start, stop = F.col(on) & ~F.coalesce("_p", F.lit(False)), ~F.col(on) & F.coalesce("_p", F.lit(False))
    return s.groupBy(scenario).agg(F.count_if(start).alias("starts"), F.min(F.when(start, F.col(time))).alias("first_start"), F.max(F.when(stop, F.col(time))).alias("last_stop"), F.count_if(F.col(on) & (F.col("_i") > 1)).alias("on_steps"))


def diurnal_extension(df: DataFrame, key: str, time: str, value: str, horizon: DataFrame, fallback_us: int = 3 * HOUR, step_us: int | None = None) -> DataFrame:
    """key, time, value of the steps after a series' end up to its `horizon` (key, horizon): a day before's value, not below 0.

    The steps are the median step of the series (or as told), and the horizon itself. A value is interpolated 24 hours earlier, or as
    many days as it takes to reach the series; where that is before its first sample, it is the last one.
    """
    day = 24 * HOUR
    base = df.groupBy(key).agg(F.min(micros(time)).alias("_a"), F.max(micros(time)).alias("_z"), F.max_by(value, time).alias("_last"))
    base = base.join(horizon.select(key, micros("horizon").alias("_h")), key).where("_h > _z")
    if step_us:
        base = base.withColumn("_step", F.lit(step_us))
    else:
        back = micros(time) - F.lag(micros(time)).over(Window.partitionBy(key).orderBy(time))
        steps = df.select(key, back.alias("_d")).groupBy(key).agg(F.floor(F.median("_d")).alias("_step"))
        base = base.join(steps, key, "left").withColumn("_step", F.when(F.col("_step") > 0, F.col("_step")).otherwise(fallback_us))
    regular = F.when(F.col("_z") + F.col("_step") <= F.col("_h"), F.sequence(F.col("_z") + F.col("_step"), F.col("_h"), F.col("_step"))).otherwise(F.array().cast("array<bigint>"))
    grid = base.withColumn("_at", F.explode(F.array_union(regular, F.array("_h"))))
    back = F.col("_at") - day * F.ceil((F.col("_at") - F.col("_z")) / day)
    grid = grid.withColumn("_from", back)
    asked = grid.select(key, F.timestamp_micros("_from").cast("timestamp_ntz").alias(time)).distinct()
    found = so.interpolate(asked, df, key, time, value).select(key, micros(time).alias("_from"), F.col(value).alias("_v"))
    v = F.when(F.col("_from") >= F.col("_a"), F.col("_v")).otherwise(F.col("_last"))
    return grid.join(found, [key, "_from"]).select(key, F.timestamp_micros("_at").cast("timestamp_ntz").alias(time), F.greatest(F.lit(0.0), v).alias(value))


def projection(df: DataFrame, key: str, time: str, value: str, minutes: float, degree: int, ahead: Sequence[float], low: float = 0.0, high: float = 100.0) -> DataFrame:
    """key, ahead (minutes), projected: a polynomial of degree 1 or 2 through a series' last `minutes`, bounded.

    The fit is by sums of powers, so a series is one aggregation. Two samples take degree 1, one sample has no projection.
    """
    x = (micros(time) - F.max(micros(time)).over(Window.partitionBy(key))) / MINUTE / 1440
    t = df.where(F.col(value).isNotNull()).select(key, x.alias("_x"), F.col(value).cast("double").alias("_y")).where(F.col("_x") >= -minutes / 1440)
    p = list(accumulate([F.lit(1.0)] + [F.col("_x")] * 4, lambda a, b: a * b))
    g = t.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(p[i]).alias(f"x{i}") for i in range(1, 5)], *[F.sum(p[i] * F.col("_y")).alias(f"y{i}") for i in range(3)]).where("n >= 2")
    n, x1, x2, x3, x4, y0, y1, y2 = (F.col(c) for c in ("n", "x1", "x2", "x3", "x4", "y0", "y1", "y2"))
    slope = (n * y1 - x1 * y0) / F.nullif(n * x2 - x1 * x1, F.lit(0.0))
    line = ((y0 - slope * x1) / n, slope, F.lit(0.0))
    det = F.nullif(n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x2 * x3) + x2 * (x1 * x3 - x2 * x2), F.lit(0.0))
    curve = (
        (y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - y2 * x3) + x2 * (y1 * x3 - y2 * x2)) / det,
        (n * (y1 * x4 - y2 * x3) - y0 * (x1 * x4 - x2 * x3) + x2 * (x1 * y2 - x2 * y1)) / det,
        (n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - x2 * y1) + y0 * (x1 * x3 - x2 * x2)) / det,
    )
    square = (n > 2) & det.isNotNull() if degree > 1 else F.lit(False)
    fit = g.select(key, *[F.when(square, c).otherwise(a).alias(f"c{i}") for i, (a, c) in enumerate(zip(line, curve))])
    at = F.explode(F.array(*[F.lit(float(a)) for a in ahead]))
    z = F.col("ahead") / 1440
    return fit.select("*", at.alias("ahead")).select(key, "ahead", F.least(F.lit(high), F.greatest(F.lit(low), F.col("c0") + F.col("c1") * z + F.col("c2") * z * z)).alias("projected"))


def continuation(df: DataFrame, key: str, time: str, value: str, recovery: float = 95.0, minimum: float = 40.0, horizon: int = 96) -> DataFrame:
    """key, eligible, reason, recovery_time, low: whether a median path recovers before it falls under the minimum.

    Of the first `horizon` + 1 steps: a path that stays at the recovery level holds to the end; else the first step at
    that level after the first dip counts, and the lowest value up to it. Fewer than two steps, or a null among them,
    are no forecast.
    """
    w = Window.partitionBy(key).orderBy(time)
    few = df.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") <= horizon)
    g = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col(time).alias("t"), F.col(value).cast("double").alias("v")))).alias("s"))  # horizon + 1 steps at most
    v0, eps = F.element_at("s", 1)["v"], 1e-9
    dip = F.array_min(F.transform(F.filter("s", lambda x: (x["i"] >= 1) & (x["v"] < recovery - eps)), lambda x: x["i"]))
    g = g.withColumns({"_dip": dip, "_ok": (F.size("s") >= 2) & ~F.exists("s", lambda x: x["v"].isNull()), "_high": v0 >= recovery})
    begin = F.when(F.col("_high"), F.col("_dip") + 1).otherwise(1)
    back = F.array_min(F.transform(F.filter("s", lambda x: (x["i"] >= begin) & (x["v"] >= recovery - eps)), lambda x: x["i"]))
    g = g.withColumn("_at", F.when(F.col("_high") & F.col("_dip").isNull(), F.size("s") - 1).otherwise(back))
    low = F.array_min(F.transform(F.filter("s", lambda x: F.col("_at").isNull() | (x["i"] <= F.col("_at"))), lambda x: x["v"]))
    g = g.withColumn("_low", low)
    reason = F.when(~F.col("_ok"), "insufficient_forecast").when(F.col("_at").isNull(), "does_not_recover").when(F.col("_low") < minimum - eps, "breaches_minimum").when(F.col("_high") & F.col("_dip").isNull(), "stays").otherwise("recovers")
    r = g.withColumn("reason", reason)
    said = F.col("reason") != "insufficient_forecast"
    return r.select(key, F.col("reason").isin("stays", "recovers").alias("eligible"), "reason", F.when(said, F.get("s", F.col("_at").cast("int"))["t"]).alias("recovery_time"), F.when(said, F.col("_low")).alias("low"))
