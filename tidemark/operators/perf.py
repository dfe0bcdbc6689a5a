"""Summary of a performance log: timings, phases, sessions, counters, coverage and the slowest rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import latency_stats

SHAPE = ("section", "name", "n", "value", "p50", "p95", "high")


def client_family(agent: Column) -> Column:
    """The kind of client by its user agent: bots first, then tablets, then phones."""
    a = F.lower(F.coalesce(agent, F.lit("")))
    return F.when(a == "", "unknown").when(a.rlike("bot|spider|crawler"), "bot").when(a.rlike("ipad|tablet"), "tablet").when(a.rlike("mobi|iphone|android"), "mobile").otherwise("desktop")


def top(df: DataFrame, section: str, name: Column, most: int | None = 10) -> DataFrame:
    """The most frequent names, ties by name; all if `most` is None."""
    n = df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return (n if most is None else n.orderBy(F.desc("n"), "name").limit(most)).withColumn("section", F.lit(section))


def performance_summary(log: DataFrame, phases: Sequence[str], gauges: Sequence[str], rendered: str, loaded: str, closed: str, beat: str, changed: str, covered: Sequence[str], slowest: int = 10) -> DataFrame:
    """Sections as rows (section, name, n, value, p50, p95, high) of a log with event, instrument, session, duration_ms, control, agent, path, event_id, and the columns of `phases` and `gauges`.

    timing: durations per event and instrument; phase: each phase of the rendering event, per instrument; session: distinct
    sessions, events of three kinds, the greatest gauges (0 without any); change, client, path: counters of the events `changed` and `loaded`;
    coverage: events of `covered` kinds per instrument; slowest: rows with the longest durations. Values that aren't there don't count.
    """
    named = lambda *c: F.concat_ws("/", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    stats = lambda df, section, *keys: df.select(F.lit(section).alias("section"), named(*keys).alias("name"), "n", F.col("mean").alias("value"), "p50", "p95", F.col("max").alias("high"))
    timing = stats(latency_stats(log.where("duration_ms IS NOT NULL"), ["event", "instrument"], "duration_ms"), "timing", "event", "instrument")
    long = log.where(F.col("event") == rendered).select("instrument", *[F.col(p).cast("double").alias(p) for p in phases]).unpivot("instrument", list(phases), "phase", "v").where("v IS NOT NULL")
    phase = stats(latency_stats(long, ["instrument", "phase"], "v"), "phase", "instrument", "phase")
    is_ = lambda e: F.count_if(F.col("event") == e).cast("double")
    facts = {"sessions": F.count_distinct("session").cast("double"), "loaded": is_(loaded), "closed": is_(closed), "heartbeats": is_(beat), **{f"max_{g}": F.coalesce(F.max(g), F.lit(0)).cast("double") for g in gauges}}
    session = log.agg(*[c.alias(n) for n, c in facts.items()]).unpivot([], list(facts), "name", "value").withColumn("section", F.lit("session"))
    on = lambda e: log.where(F.col("event") == e)
    parts = [
        timing, phase, session,
        top(on(changed), "change", named("instrument", "control")),
        top(on(loaded), "client", client_family(F.col("agent")), None),
        top(on(loaded).where("path <> ''"), "path", F.col("path")),
        top(log.where(F.col("event").isin(list(covered))), "coverage", F.coalesce(F.col("instrument").cast("string"), F.lit("")), None),
        log.where("duration_ms IS NOT NULL").orderBy(F.desc("duration_ms"), "event_id").limit(slowest).select(F.lit("slowest").alias("section"), F.col("event_id").cast("string").alias("name"), F.col("duration_ms").alias("value")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*SHAPE)
