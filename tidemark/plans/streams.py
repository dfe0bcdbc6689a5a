"""Streams over the event table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import panes
from ..registry import query
from ..sources.bindings import WIDE15, events, wide15
from ..sources.listing import listing
from ..sources.scratch import folder
from ..streaming import streams as st
from ..streaming.publish import publish_changes
from ..streaming.store import followed

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf):
    # a pattern, as the table is a file or a folder
    return st.source(spark, f"{sf}/events.parque[t]", SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, value FROM events")
def t1_frontier_append(spark, sf):
    """The table arrives twice; the state lets each event through once."""
    e = _stream(spark, sf)
    return st.run_to_table(st.frontier_append(e.union(e), "ts", ["event_id"], "40 days").select("event_id", "value"), "appended")


@query("""WITH m AS (SELECT DISTINCT CAST(ts AS DATE) AS day, date_trunc('day', ts) + INTERVAL 1 day + to_hours(CAST(day(ts) * 7 % 5 AS INT)) AS modified FROM events), d AS (SELECT min(day) AS first FROM m WHERE modified > TIMESTAMP '2024-01-20 01:50:00')
SELECT day, modified FROM m, d WHERE modified <= TIMESTAMP '2024-01-20 01:50:00' AND (first IS NULL OR day < first)""")
def t2_hold_back(spark, sf):
    """A file a day is written and listed with its time of change: what isn't settled for ten minutes, and all that is later, waits."""
    at = folder(spark, "days")
    events(spark, sf).select(F.to_date("ts").alias("day"), F.col("event_id").cast("string").alias("value")).repartition("day").write.partitionBy("day").text(at)
    day = F.regexp_extract("path", "day=([0-9-]+)", 1).cast("date")
    changed = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1), (F.day("day") * 7 % 5).cast("int"))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for row in listing(spark, at, "*.txt").select("path", day.alias("day")).select("path", (micros(changed) / 1000).cast("long").alias("ms")).collect():  # a row a day
        p = fs.Path(row["path"])
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setTimes(p, row["ms"], -1)
    files = listing(spark, at, "*.txt").select("path", "modified", day.alias("day"), day.cast("timestamp_ntz").alias("time"))
    return st.held_back(files, "modified", "2024-01-20 02:00:00", 600).select("day", "modified").distinct()


@query("SELECT user_id, ts, value FROM (SELECT DISTINCT ON (user_id, date_trunc('minute', ts)) * FROM events ORDER BY user_id, date_trunc('minute', ts), event_id)")
def t4_schema_repair(spark, sf):
    """A store with repeats, in no order, is found faulty and rebuilt: the first record of each minute, in order of time; the old one stays."""
    e = events(spark, sf)
    at = folder(spark, "faulty")
    e.union(e.where("event_id % 3 = 0")).withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz")).write.parquet(at)
    fixed, _ = st.repaired(spark, at, "user_id", "minute", "event_id")
    return fixed.select("user_id", "ts", "value")


_NOTICES = """ev AS (SELECT user_id AS id, epoch_us(ts) AS t, value > 25 AS on_ FROM events), nw AS (SELECT max(t) AS now FROM ev), ch AS (SELECT *, CASE WHEN on_ IS DISTINCT FROM lag(on_) OVER (PARTITION BY id ORDER BY t) THEN 1 ELSE 0 END AS c FROM ev),
rn AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM ch), g AS (SELECT id, run, bool_or(on_) AS on_, min(t) AS first FROM rn GROUP BY 1, 2), en AS (SELECT *, lead(first) OVER (PARTITION BY id ORDER BY run) AS stop FROM g),
un AS (SELECT *, coalesce(stop - 1, now) AS until FROM en, nw WHERE on_), nn AS (SELECT *, CASE WHEN until >= first + 3600000000 THEN (until - first - 3600000000) // 43200000000 + 1 ELSE 0 END AS n FROM un),
notices AS (SELECT id, make_timestamp(CAST(first + 3600000000 + k * 43200000000 AS BIGINT)) AS ts, 'alert' AS kind, k AS nth FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM nn) UNION ALL SELECT id, make_timestamp(CAST(stop AS BIGINT)), 'recovery', CAST(n AS BIGINT) FROM nn WHERE stop IS NOT NULL AND n > 0)"""


@query(f"WITH {_NOTICES} SELECT id, ts, kind, nth FROM notices")
def t5_alert_states(spark, sf):
    a = _stream(spark, sf).select(F.col("user_id").alias("id"), "ts", (F.col("value") > 25).alias("on"))
    return st.alert_states(a).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {WIDE15}, l AS (SELECT time, 'click' AS rule, click AS v, 40.0 AS lim FROM wide15 UNION ALL SELECT time, 'error', error, 60.0 FROM wide15) SELECT time, rule, round(v, 6) AS v FROM l WHERE v >= lim")
def t6_alert_rules(spark, sf):
    rules = spark.createDataFrame([("click", 40.0), ("error", 60.0)], "rule string, lim double")
    l = wide15(spark, sf).unpivot("time", ["click", "error", "view"], "rule", "v")  # noqa: E741
    return l.join(F.broadcast(rules), "rule").where("v >= lim").select("time", "rule", F.round("v", 6).alias("v"))


@query("WITH r AS (SELECT user_id AS site, time_bucket(INTERVAL 1 hour, ts) AS issue, event_id AS seq, value FROM events), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY site, issue ORDER BY seq DESC) = 1) SELECT site, issue, seq, value FROM l WHERE issue >= (SELECT max(issue) FROM r) - INTERVAL 21 day")
def t7_rolling_retention(spark, sf):
    """Issues merge into a store as they arrive, the last one of an hour wins; what is older than 21 days before the newest is pruned."""
    r = _stream(spark, sf).select(F.col("user_id").alias("site"), F.date_trunc("hour", "ts").alias("issue"), F.col("event_id").alias("seq"), "value")
    store = followed(r, ["site", "issue"], "seq")
    newest = store.read().agg(F.max("issue")).first()[0]
    store.prune(F.col("issue") >= F.lit(newest) - F.make_dt_interval(F.lit(21)))
    return store.read().withColumn("issue", F.col("issue").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, CAST(floor(value / 20) AS BIGINT) AS level, event_type AS kind FROM events), p AS (SELECT *, lag(level) OVER w AS a, lag(kind) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, ts, concat_ws(',', CASE WHEN level IS DISTINCT FROM a THEN 'level' END, CASE WHEN kind IS DISTINCT FROM b THEN 'kind' END) AS reasons FROM p WHERE level IS DISTINCT FROM a OR kind IS DISTINCT FROM b""")
def t9_skip_unchanged(spark, sf):
    """What a station publishes when its inputs change, and which did; its last inputs are kept in a store."""
    s = _stream(spark, sf).select("user_id", "ts", F.floor(F.col("value") / 20).alias("level"), F.col("event_type").alias("kind"))
    out = publish_changes(s, "user_id", "ts", ["level", "kind"])
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.array_join("reasons", ",").alias("reasons"))


@query("""WITH p AS (SELECT event_type, time_bucket(INTERVAL 1 hour, ts - INTERVAL 1 microsecond) + INTERVAL 1 hour AS pane, value FROM events), w AS (SELECT event_type, pane + to_hours(CAST(k AS INT)) AS now, value FROM p, (SELECT unnest(range(24)) AS k))
SELECT event_type, now, count(*) AS n, count_if(value > 30) AS high FROM w GROUP BY 1, 2""")
def t10_windowed_counters(spark, sf):
    """Counts of the trailing day, for each hour: the stream keeps hourly panes, of which a window is 24."""
    w = F.window(F.col("ts") - F.make_dt_interval(secs=F.lit(0.000001)), "1 hour")
    e = _stream(spark, sf).withWatermark("ts", "1 hour").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 30).alias("high"))
    hourly = st.run_to_snapshot(e.select("event_type", micros(F.col("w.end")).alias("pane"), "n", "high"), "panes")
    day = panes.slid(hourly, "pane", ["n", "high"], ["event_type"]).where("n > 0")
    return day.select("event_type", F.timestamp_micros("pane").cast("timestamp_ntz").alias("now"), "n", "high")


@query("WITH l AS (SELECT user_id AS id, arg_max(event_id, event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT id, seq, value FROM l ORDER BY seq DESC LIMIT 4096")
def t11_decision_log(spark, sf):
    """Decisions merge into a store by id; of the log the newest 4096 are shown."""
    store = followed(_stream(spark, sf).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value"), ["id"], "seq")
    return st.upsert_log(store.read(), "id", "seq", 4096)


@query("SELECT (SELECT max(ts) FROM events WHERE event_type = 'view') >= TIMESTAMP '2024-01-31' - INTERVAL 2 day AS fresh, (SELECT max(ts) + INTERVAL 60 hour FROM events WHERE event_type = 'signup') >= TIMESTAMP '2024-01-31' + INTERVAL 24 hour AS covered")
def t12_input_gate(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    newest = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ts")))
    return events(spark, sf).agg((newest("view") >= now - F.make_dt_interval(F.lit(2))).alias("fresh"), (newest("signup") + F.make_dt_interval(hours=F.lit(60)) >= now + F.make_dt_interval(hours=F.lit(24))).alias("covered"))
