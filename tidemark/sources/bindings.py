"""The series, archives and catalogs that the queries take from the given tables, in Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import bucket

TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user: key, time, v."""
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), F.col("value").alias("v"))


SERIES = "series AS (SELECT user_id AS key, ts AS time, value AS v FROM events)"


def wide15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of 15 minutes, a column per event type, null where a bucket has none."""
    e = events(spark, sf_dir)
    return e.groupBy(bucket("ts", 15).alias("time")).agg(*[F.median(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in TYPES])


WIDE15 = "wide15 AS (SELECT time_bucket(INTERVAL 15 minute, ts) AS time, " + ", ".join(f"median(value) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1)"


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts: each signup issues four leads; the cycle is the issue time floored to six hours."""
    e = events(spark, sf_dir).where("event_type = 'signup'")
    steps = F.explode(F.array(*[F.lit(x) for x in (3, 12, 30, 60)]))
    cycle = F.window("ts", "6 hours")["start"]
    rows = e.select(F.col("ts").alias("issue_time"), cycle.alias("cycle_time"), F.col("user_id").alias("site"), F.col("value"), steps.alias("lead"))
    return rows.select("issue_time", "cycle_time", "site", "lead", (F.col("issue_time") + F.make_dt_interval(hours=F.col("lead"))).alias("valid_time"), (F.col("value") * (1 + F.col("lead") / 100)).alias("forecast"))


ARCHIVE = """archive AS (SELECT ts AS issue_time, time_bucket(INTERVAL 6 hour, ts) AS cycle_time, user_id AS site, lead,
  ts + to_hours(lead) AS valid_time, value * (1 + lead / 100.0::DOUBLE) AS forecast
  FROM events, (SELECT unnest([3, 12, 30, 60]) AS lead) WHERE event_type = 'signup')"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: hourly medians of the views."""
    e = events(spark, sf_dir).where("event_type = 'view'")
    return e.groupBy(bucket("ts", 60).alias("time")).agg(F.median("value").alias("obs"))


OBSERVED = "observed AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS time, median(value) AS obs FROM events WHERE event_type = 'view' GROUP BY 1)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty members of each forecast, beside it."""
    m = F.explode(F.sequence(F.lit(1), F.lit(20)))
    return archive(spark, sf_dir).withColumn("member", m).withColumn("value", F.col("forecast") * (0.75 + 0.5 * (F.col("member") - 1) / 19))


#: A forecast's twenty members as factors, and what is taken off each for the change of a balance.
SPREAD = (tuple(0.75 + 0.5 * (m - 1) / 19 for m in range(1, 21)), 20.0)


MEMBERS = ARCHIVE + """, members AS (SELECT issue_time, cycle_time, site, lead, valid_time, member,
  forecast * (0.75::DOUBLE + 0.5::DOUBLE * (member - 1) / 19) AS value, forecast FROM archive, (SELECT unnest(range(1, 21)) AS member))"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media catalog: type, kind, time, day, path, size."""
    e = events(spark, sf_dir)
    return e.select(F.col("event_type").alias("media_type"), F.when(F.col("user_id") % 3 == 0, "video").otherwise("image").alias("kind"), F.col("ts").alias("time"), F.to_date("ts").alias("day"), F.concat(F.lit("m/"), F.col("event_id").cast("string")).alias("path"), F.col("value").alias("size"), "event_id")


MEDIA = """media AS (SELECT event_type AS media_type, CASE WHEN user_id % 3 = 0 THEN 'video' ELSE 'image' END AS kind, ts AS time,
  CAST(ts AS DATE) AS day, 'm/' || event_id AS path, value AS size, event_id FROM events)"""


def perflog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A performance log: event, instrument, duration_ms, session, extra."""
    e = events(spark, sf_dir)
    return e.select(F.col("ts"), F.col("event_type").alias("event"), (F.col("user_id") % 7).alias("instrument"), F.col("value").alias("duration_ms"), F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("double").alias("k"), "event_id")


PERFLOG = """perflog AS (SELECT ts, event_type AS event, user_id % 7 AS instrument, value AS duration_ms, user_id AS session,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_id FROM events)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user a counter that grows by the values and wraps at 500: key, time, counter."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), (F.sum(F.round("value").cast("long")).over(w) % 500).alias("counter"))


COUNTERS = """counters AS (SELECT user_id AS key, ts AS time, sum(CAST(round(value) AS BIGINT)) OVER
  (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) % 500 AS counter FROM events)"""
