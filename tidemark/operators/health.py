"""Health of streams from a snapshot of states, root causes, and issues that switches hold back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros


def level_of(bad: Column, good: Column) -> Column:
    """Of counts of states: red if any is bad, green if any is good, else unknown."""
    return F.when(bad > 0, "red").when(good > 0, "green").otherwise("unknown")


def stream_health(states: DataFrame) -> DataFrame:
    """stream, level, source_level, service_level, healthy, services, failed and detail from rows stream, role (source or service), name, ok (null: not known).

    A stream is red if its source or a service is, green if either is green; the detail names the source before the first
    three failed services, in order of name.
    """
    source, service = F.col("role") == "source", F.col("role") == "service"
    n = lambda role, ok: F.count_if(role & (F.coalesce(F.col("ok"), F.lit(not ok)) == ok))
    g = states.groupBy("stream").agg(
        level_of(n(source, False), n(source, True)).alias("source_level"), level_of(n(service, False), n(service, True)).alias("service_level"),
        n(service, True).alias("healthy"), F.count_if(service).alias("services"),
        F.array_sort(F.collect_list(F.when(service & ~F.col("ok"), F.col("name")))).alias("bad"),
    )
    both = F.array("source_level", "service_level")
    level = F.when(F.array_contains(both, "red"), "red").when(F.array_contains(both, "green"), "green").otherwise("unknown")
    detail = F.when(F.col("source_level") == "red", "Source is unhealthy").when(F.size("bad") > 0, F.concat(F.lit("Unhealthy: "), F.array_join(F.slice("bad", 1, 3), ", "))).when(level == "green", "Source and services healthy").otherwise("No current status")
    return g.select("stream", level.alias("level"), "source_level", "service_level", "healthy", "services", F.array_join("bad", ",").alias("failed"), detail.alias("detail"))


def root_causes(streams: DataFrame) -> DataFrame:
    """cause, level, streams: 'source' for streams whose source is red, 'processing' for those that are red though their source isn't; green if none is, unknown without streams."""
    source = F.col("source_level") == "red"
    counts = streams.agg(F.count_if(source).alias("source"), F.count_if((F.col("level") == "red") & ~source).alias("processing"), F.count(F.lit(1)).alias("n"))
    long = counts.unpivot(["n"], ["source", "processing"], "cause", "streams")
    return long.select("cause", F.when(F.col("streams") > 0, "red").when(F.col("n") > 0, "green").otherwise("unknown").alias("level"), "streams")


def let_through(issues: DataFrame, switches: DataFrame, key: str, time: str, on: str, now: Column, max_age_us: int) -> DataFrame:
    """The issues whose switch isn't known to be off: the newest state of its key counts, if it is no older than `max_age_us`; a stale, null or missing one holds nothing back."""
    newest = switches.groupBy(key).agg(F.max_by(on, time).alias("_on"), F.max(micros(time)).alias("_at"))
    fresh = newest.where(micros(now) - F.col("_at") <= max_age_us).select(key, "_on")
    return issues.join(fresh, key, "left").where(F.coalesce(F.col("_on"), F.lit(True))).drop("_on")
