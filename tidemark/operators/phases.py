"""Load phases of a station's states: startup, then steady or low and high, and the load path that they make expected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import MINUTE, micros
from ..sources.scratch import table
from . import blocks
from . import series as so
from .gaps import widest_gap
from .learn import material, startup_boundary
from .stats import middle

PHASES = ("low", "high", "steady", "startup")


def debounced(df: DataFrame, keys: Sequence[str], time: str, label: str, least: int = 2) -> DataFrame:
    """`label` of each run shorter than `least` becomes that of the run before; leading ones take the second run's. Series of under three rows stay.

    Runs are numbered block by block and counted by aggregation, the labels of long ones carried on from block to block.
    """
    keys = list(keys)
    r = table(blocks.runs(df.withColumn("_g", F.struct(*keys)), keys, time, label, name="_seg"), "runs")
    size = r.groupBy("_g", "_seg").agg(F.count(F.lit(1)).alias("_n"), F.first(label).alias("_l"))
    whole = size.groupBy("_g").agg(F.sum("_n").alias("_all"), F.max(F.when(F.col("_seg") == 2, F.col("_l"))).alias("_second"))
    known = r.join(size.drop("_l"), ["_g", "_seg"]).join(whole, "_g")
    carried = blocks.filled(known, keys, time, F.when(F.col("_n") >= least, F.col(label)), "_carried_label")
    return carried.withColumn(label, F.when(F.col("_all") < 3, F.col(label)).otherwise(F.coalesce("_carried_label", "_second", label))).drop("_g", "_seg", "_n", "_all", "_second", "_carried_label")


def phase_learning(df: DataFrame, key: str, time: str, value: str, state: str, gap_factor: float = 2.5, least_gap_us: int = 30 * MINUTE, limit_minutes: float = 720.0, minimum: int = 4, occurrences: int = 2, least: float = 20.0, relative: float = 0.08) -> DataFrame:
    """A row per key and state: its phases' weights, dwell times (minutes) and quantiles, startup durations, and the current phase.

    Rows have distinct times per key; values under 0 and nulls are left out. A run is a state unbroken by gaps beyond
    `gap_factor` cadences. Its startup ends at its boundary (see startup_boundary); what follows is split at its widest
    gap into low and high, if that is material and both occur in `occurrences` debounced stretches, else steady (of the
    latest stretch's side, where both sides are material but too rare). A startup phase needs as many boundaries
    and a level of its own. The state of a key's newest run has the phase that the run ends in; others their first.
    """
    on, run_of = [key, state], [key, state, "run"]
    v = df.where(F.col(value) >= 0).select(key, F.col(time).alias("time"), F.col(value).cast("double").alias("x"), state)
    steps = v.select(key, (micros("time") - F.lag(micros("time")).over(Window.partitionBy(key).orderBy("time"))).alias("_d")).groupBy(key).agg(F.median("_d").alias("_m"))
    d = v.join(steps, key).withColumn("c", F.when(F.col("_m") > 0, F.greatest(F.lit(1.0), F.col("_m") / MINUTE)).otherwise(15.0)).drop("_m")
    runs = so.islands(d, key, "time", state, F.greatest(F.col("c") * (gap_factor * MINUTE), F.lit(float(least_gap_us))))
    runs = table(runs, "runs")
    bound = startup_boundary(runs, run_of, "time", "x", F.col("c"), minimum, limit_minutes, least, relative).drop("change")
    r = runs.join(bound, run_of).withColumn("i", F.row_number().over(Window.partitionBy(*run_of).orderBy("time")) - 1)
    r = table(r.withColumn("starting", F.col("i") < F.col("boundary")), "startups")
    steady = r.where("NOT starting")
    # the widest gap between steady values, and whether its sides differ
    cut = table(widest_gap(steady, on, "x").select(*on, "low").withColumnRenamed("low", "cut"), "cuts")
    sides = middle(steady.join(cut, on).withColumn("high", F.coalesce(F.col("x") > F.col("cut"), F.lit(False))), [*on, "high"], "x", "med", 3.0)
    of = lambda c, high: F.max(F.when(F.col("high") == high, F.col(c)))
    two = sides.groupBy(*on).agg(of("med", False).alias("ml"), of("med", True).alias("mh"), of("_scale", False).alias("sl"), of("_scale", True).alias("sh"), F.coalesce(of("_n", False), F.lit(0)).alias("nl"), F.coalesce(of("_n", True), F.lit(0)).alias("nh"))
    apart = F.coalesce((F.col("nl") >= minimum) & (F.col("nh") >= minimum) & material(F.col("ml"), F.col("mh"), F.col("sl"), F.col("sh"), least, relative), F.lit(False))
    split = table(two.join(cut, on).select(*on, "cut", "ml", "mh", apart.alias("apart")), "splits")
    near = F.when(F.abs(F.col("x") - F.col("ml")) <= F.abs(F.col("x") - F.col("mh")), "low").otherwise("high")
    labelled = table(debounced(steady.join(split.where("apart"), on).withColumn("label", near), run_of, "time", "label"), "labels")
    seg = _stretches(labelled, run_of).groupBy(*on).agg(F.count_if(F.col("label") == "low").alias("lows"), F.count_if(F.col("label") == "high").alias("highs"))
    last = labelled.groupBy(*on).agg(F.max_by("label", "time").alias("latest"))
    kind = split.join(seg, on, "left").join(last, on, "left").withColumn("both", F.coalesce(F.col("apart") & (F.col("lows") >= occurrences) & (F.col("highs") >= occurrences), F.lit(False)))
    # the final label of every row behind its boundary
    fine = labelled.select(*run_of, "time", F.col("label").alias("_l"))
    told = table(steady.join(kind, on).join(fine, [*run_of, "time"], "left").withColumn("label", F.when(F.col("both"), F.col("_l")).otherwise("steady")), "phases")
    # levels
    q = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    mid = F.when(F.col("x") <= (F.col("ml") + F.col("mh")) / 2, "low").otherwise("high")
    kept = ~F.col("both") & (~F.col("apart") | (mid == F.col("latest")))
    level = lambda ok: F.percentile(F.when(ok, F.col("x")), q)
    levels = told.groupBy(*on).agg(level(F.col("both") & (F.col("x") <= F.col("cut"))).alias("q_low"), level(F.col("both") & (F.col("x") > F.col("cut"))).alias("q_high"), level(kept).alias("q_steady"))
    begun = r.where("starting")
    parts = middle(begun.select(*on, "x"), on, "x", "bm", 3.0).withColumnRenamed("_scale", "bs").drop("_n").join(middle(steady.select(*on, "x"), on, "x", "am", 3.0).withColumnRenamed("_scale", "as_").drop("_n"), on)
    durations = begun.groupBy(*run_of).agg((F.count(F.lit(1)) * F.max("c")).alias("minutes")).groupBy(*on).agg(F.percentile("minutes", q).alias("dur"), F.count(F.lit(1)).alias("starts"))
    startup = begun.groupBy(*on).agg(F.percentile("x", q).alias("q_startup")).join(durations, on).join(parts, on).where((F.col("starts") >= occurrences) & material(F.col("bm"), F.col("am"), F.col("bs"), F.col("as_"), least, relative)).select(*on, "q_startup", "dur")
    # stretches of the final labels
    final = _stretches(told.select(*run_of, "time", "label", "c", "boundary"), run_of, ["c", "boundary"])
    dwell = lambda p: F.coalesce(F.median(F.when(F.col("label") == p, F.col("n") * F.col("c"))), F.max("c"))
    count = lambda p: F.sum(F.when(F.col("label") == p, F.col("n")).otherwise(0))
    shares = final.groupBy(*on).agg(*[count(p).alias(f"n_{p}") for p in PHASES[:3]], *[dwell(p).alias(f"{p}_dwell") for p in PHASES[:3]], (F.count(F.lit(1)) - F.count_if((F.col("nth") == 1) & (F.col("boundary") == 0))).alias("changes"))
    whole = r.groupBy(*on).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("run").alias("episodes"), F.max("time").alias("last_time"))
    # the newest run of each key
    ends = r.groupBy(*run_of).agg(F.min("time").alias("began"), F.max("time").alias("ended"), F.max("boundary").alias("bound"), F.max("c").alias("cadence")).withColumn("newest", F.max("ended").over(Window.partitionBy(key))).where("ended = newest")
    tail = final.groupBy(*run_of).agg(F.max_by("label", "nth").alias("at_end"), F.max(F.when((F.col("nth") > 1) | (F.col("boundary") > 0), F.col("start"))).alias("turned"))
    current = ends.join(tail, run_of).select(*on, "began", "bound", "cadence", "at_end", F.coalesce("turned", "began").alias("turned"), "newest")
    j = whole.join(kind.select(*on, "both"), on).join(levels, on).join(shares, on).join(startup, on, "left").join(current, on, "left")
    elapsed = (micros("newest") - micros("began")) / MINUTE + F.col("cadence")
    fresh = F.coalesce(F.col("q_startup").isNotNull() & (F.col("bound") == 0) & (elapsed <= F.greatest(F.col("dur")[2], F.col("dur")[1], F.col("cadence"))), F.lit(False))
    first = F.when(F.col("both"), "low").otherwise("steady")
    steady_n = F.greatest(F.col("n_low") + F.col("n_high") + F.col("n_steady"), F.lit(1))
    of_kind = lambda p, c: F.when(F.col("both") if p != "steady" else ~F.col("both"), c)
    return j.select(
        *on, F.when(fresh, "startup").otherwise(F.coalesce("at_end", first)).alias("current_phase"), F.coalesce("began", "last_time").alias("state_started"), F.when(fresh, F.col("began")).otherwise(F.coalesce("turned", "last_time")).alias("phase_started"),
        *[F.coalesce(F.col("dur")[i], F.lit(0.0)).alias(f"startup_min_{n}") for i, n in enumerate(("p10", "p50", "p90"))], "samples", "episodes", "changes",
        *[of_kind(p, F.col(f"n_{p}") / steady_n).alias(f"{p}_weight") for p in PHASES[:3]], *[of_kind(p, F.col(f"{p}_dwell")).alias(f"{p}_dwell") for p in PHASES[:3]],
        *[F.col(f"q_{p}")[i].alias(f"{p}_{n}") for p in PHASES for i, n in enumerate(("p10", "p50", "p90"))],
    )


def _stretches(rows: DataFrame, run_of: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """run_of, nth, label, n, start and `carry` of each stretch of one label in a run."""
    w = Window.partitionBy(*run_of).orderBy("time")
    flag = F.when(F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)
    s = rows.withColumn("_new", flag).withColumn("nth", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*run_of, "nth", "label").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("start"), *[F.max(c).alias(c) for c in carry])


def load_path(grid: DataFrame, learned: DataFrame, key: str, time: str) -> DataFrame:
    """key, time, phase, p10, p50, p90 of `grid` (key, time): the expected load from a key's current state on.

    `learned` has a row a key (of phase_learning). In startup its levels hold until the median startup is over; then, and
    in any other phase, the band reaches from the lowest P10 to the highest P90 of the steady phases, and the middle is that of the
    current phase, after a startup that of the heaviest.
    """
    c = F.col
    heaviest = F.when(c("steady_p50").isNotNull(), "steady").when(c("high_weight") > c("low_weight"), "high").otherwise("low")
    over = micros(time) > micros("state_started") + c("startup_min_p50") * MINUTE
    known = F.when(c("current_phase") == "startup", c("startup_p50").isNotNull()).otherwise(F.lit(True))
    now = F.when(known, c("current_phase")).otherwise(heaviest)
    phase = F.when((now == "startup") & over, heaviest).otherwise(now)
    pick = lambda n, p: F.when(p == "low", c(f"low_{n}")).when(p == "high", c(f"high_{n}")).when(p == "startup", c(f"startup_{n}")).otherwise(c(f"steady_{n}"))
    j = grid.join(learned, key).withColumn("phase", phase)
    starting = c("phase") == "startup"
    low, high = F.least("low_p10", "high_p10", "steady_p10"), F.greatest("low_p90", "high_p90", "steady_p90")
    return j.select(key, time, "phase", F.when(starting, c("startup_p10")).otherwise(low).alias("p10"), pick("p50", c("phase")).alias("p50"), F.when(starting, c("startup_p90")).otherwise(high).alias("p90"))
