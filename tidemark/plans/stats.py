"""Aggregations: logs, coverage, levels, robust fits, daily summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.times import HOUR, bucket, micros
from ..operators import blocks, health
from ..operators import series as so
from ..operators import stats as op
from ..operators.gaps import widest_gap
from ..operators.phases import debounced
from ..registry import query
from ..sources.bindings import MEDIA, OBSERVED, PERFLOG, TYPES, WIDE15, events, media, observed, perflog, wide15
from ..sources.scratch import table as kept
from .series import _HOURS, hours

R = lambda c, n=6: F.round(c, n)


@query(f"WITH {PERFLOG} SELECT event, instrument, count(duration_ms) AS n, round(avg(duration_ms), 6) AS mean, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, max(duration_ms) AS max FROM perflog GROUP BY 1, 2")
def a5_latency_stats(spark, sf):
    s = op.latency_stats(perflog(spark, sf), ["event", "instrument"], "duration_ms")
    return s.select("event", "instrument", "n", R("mean").alias("mean"), R("p50").alias("p50"), R("p95").alias("p95"), "max")


@query(f"""WITH {PERFLOG}, l AS (SELECT event, 'duration_ms' AS phase, duration_ms AS v FROM perflog UNION ALL SELECT event, 'k', k FROM perflog UNION ALL SELECT event, 'instrument', instrument FROM perflog)
SELECT event, phase, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS max FROM l GROUP BY 1, 2""")
def a6_phase_stats(spark, sf):
    wide = perflog(spark, sf).select("event", "duration_ms", "k", F.col("instrument").cast("double").alias("instrument"))
    s = op.latency_stats(wide.unpivot("event", ["duration_ms", "k", "instrument"], "phase", "v"), ["event", "phase"], "v")
    return s.select("event", "phase", "n", R("mean").alias("mean"), R("p50").alias("p50"), R("p95").alias("p95"), "max")


@query(f"WITH {PERFLOG} SELECT event, count(DISTINCT session) AS sessions, count_if(duration_ms > 30) AS slow, max(k) AS gauge FROM perflog GROUP BY 1")
def a7_session_rollup(spark, sf):
    return perflog(spark, sf).groupBy("event").agg(F.count_distinct("session").alias("sessions"), F.count_if(F.col("duration_ms") > 30).alias("slow"), F.max("k").alias("gauge"))


@query(f"WITH {PERFLOG} SELECT session, count(*) AS n FROM perflog GROUP BY 1 ORDER BY n DESC, session LIMIT 10")
def a8_top_counters(spark, sf):
    return perflog(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "session").limit(10)


@query("SELECT event_type, CASE max(CASE WHEN value IS NULL THEN 1 WHEN value >= 120 THEN 4 WHEN value >= 60 THEN 3 ELSE 2 END) WHEN 1 THEN 'gray' WHEN 2 THEN 'green' WHEN 3 THEN 'amber' ELSE 'red' END AS worst, count_if(value >= 120) AS red, count_if(value >= 60 AND value < 120) AS amber FROM events GROUP BY 1")
def a20_worst_level(spark, sf):
    e = events(spark, sf).withColumn("level", op.level(F.col("value"), 60, 120))
    return e.groupBy("event_type").agg(op.worst(F.col("level")).alias("worst"), F.count_if(F.col("level") == "red").alias("red"), F.count_if(F.col("level") == "amber").alias("amber"))


@query(f"WITH {WIDE15} SELECT time, round(CASE WHEN (click IS NOT NULL)::INT + (error IS NOT NULL)::INT + (view IS NOT NULL)::INT >= 2 THEN greatest(0, coalesce(click, 0) + coalesce(error, 0) + coalesce(view, 0)) END, 6) AS total FROM wide15")
def a21_row_sum_min_count(spark, sf, least=2):
    cols = ["click", "error", "view"]
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return wide15(spark, sf).select("time", R(F.when(n >= least, F.greatest(F.lit(0.0), total))).alias("total"))


@query(f"WITH {WIDE15} SELECT time, round(greatest(click, error, purchase, signup, view), 6) AS high, round(least(click, error, purchase, signup, view), 6) AS low FROM wide15")
def a22_row_extremes(spark, sf):
    return wide15(spark, sf).select("time", R(F.greatest(*TYPES)).alias("high"), R(F.least(*TYPES)).alias("low"))


@query("SELECT date_trunc('hour', ts) AS hour, " + ", ".join(f"count_if(event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def a23_hourly_pivot(spark, sf):
    h = events(spark, sf).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).pivot("event_type", list(TYPES)).agg(F.count(F.lit(1)))
    return h.na.fill(0, list(TYPES))


@query(f"WITH {MEDIA} SELECT media_type, min(time) AS first, max(time) AS last FROM media GROUP BY 1")
def a24_time_bounds(spark, sf):
    return media(spark, sf).groupBy("media_type").agg(F.min("time").alias("first"), F.max("time").alias("last"))


@query(f"WITH {_HOURS}, o AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'signup') SELECT count(o.hour) AS seen, count(*) - count(o.hour) AS missing, count(*) AS expected FROM cal LEFT JOIN o USING (hour)")
def a25_hour_coverage(spark, sf):
    o = events(spark, sf).where("event_type = 'signup'").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.lit(1).alias("seen")).distinct()
    return hours(spark, sf).join(o, "hour", "left").agg(F.count("seen").alias("seen"), (F.count(F.lit(1)) - F.count("seen")).alias("missing"), F.count(F.lit(1)).alias("expected"))


@query("""WITH b AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM events), n AS (SELECT unnest(range(64)) AS bin),
o AS (SELECT least(63, (epoch_us(ts) - a) * 64 // (z - a)) AS bin, count(*) AS n FROM events, b WHERE event_type = 'signup' GROUP BY 1) SELECT CAST(n.bin AS INT) AS bin, coalesce(o.n, 0) AS n FROM n LEFT JOIN o ON o.bin = n.bin""")
def a26_segment_coverage(spark, sf, bins=64):
    e = events(spark, sf)
    span = e.agg(F.min(micros("ts")).alias("a"), F.max(micros("ts")).alias("z"))
    o = e.where("event_type = 'signup'").crossJoin(F.broadcast(span)).select(F.expr(f"cast(least({bins - 1}, (unix_micros(cast(ts as timestamp)) - a) * {bins} div (z - a)) as int) as bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(o, "bin", "left").na.fill(0, ["n"])


@query("SELECT date_trunc('hour', ts) AS hour, CASE WHEN count(DISTINCT event_type) FILTER (event_type IN ('signup', 'purchase', 'error')) = 3 THEN 2 WHEN count(*) FILTER (event_type IN ('signup', 'purchase', 'error')) > 0 THEN 1 ELSE 0 END AS state FROM events GROUP BY 1")
def a27_presence_state(spark, sf):
    need = F.col("event_type").isin("signup", "purchase", "error")
    n = F.count_distinct(F.when(need, F.col("event_type")))
    return events(spark, sf).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.when(n == 3, 2).when(n > 0, 1).otherwise(0).alias("state"))


_ROBUST = """m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), s AS (SELECT event_type, m, greatest(3, 1.4826 * median(abs(value - m))) AS s FROM events JOIN m USING (event_type) GROUP BY 1, 2),
k AS (SELECT e.event_type, e.value FROM events e JOIN s USING (event_type) WHERE abs(value - m) <= greatest(5 * s, 20)), m2 AS (SELECT event_type, median(value) AS median FROM k GROUP BY 1)"""


@query(f"WITH {_ROBUST} SELECT event_type, round(median, 6) AS median, round(greatest(3, 1.4826 * median(abs(value - median))), 6) AS scale, count(*) AS n FROM k JOIN m2 USING (event_type) GROUP BY event_type, median")
def a28_robust_scale(spark, sf):
    return op.robust_scale(events(spark, sf).select("event_type", "value"), ["event_type"], "value").select("event_type", R("median").alias("median"), R("scale").alias("scale"), "n")


_EPISODE = """s AS (SELECT user_id AS key, ts, value, value > 10 AS on_, lag(ts) OVER w AS pt, lag(value > 10) OVER w AS pon FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, CASE WHEN on_ AND NOT coalesce(pon AND epoch_us(ts) - epoch_us(pt) <= 86400000000, false) THEN 1 ELSE 0 END AS start FROM s)"""


def _episodes(spark, sf):
    s = events(spark, sf).select(F.col("user_id").alias("key"), "ts", "value", (F.col("value") > 10).alias("on"))
    s = blocks.before(s, "key", "ts", ["on"])
    before = F.coalesce(F.col("_before.on") & (micros("ts") - F.col("_before._t") <= 24 * HOUR), F.lit(False))
    return s.withColumn("start", (F.col("on") & ~before).cast("int")).drop("_before")


@query(f"WITH {_EPISODE} SELECT key, CAST(sum(start) AS BIGINT) AS episodes, count_if(on_) * 0.25 AS hours FROM e GROUP BY 1")
def e13_episodes(spark, sf):
    """Episodes of a condition; their length is the number of samples times 15 minutes."""
    return _episodes(spark, sf).groupBy("key").agg(F.sum("start").alias("episodes"), (F.count_if("on") * 0.25).alias("hours"))


@query(f"""WITH {_EPISODE} SELECT key, count_if(on_) AS samples, CAST(sum(start) AS BIGINT) AS episodes, round(quantile_cont(value, 0.1) FILTER (on_), 6) AS p10, round(quantile_cont(value, 0.5) FILTER (on_), 6) AS p50, round(quantile_cont(value, 0.9) FILTER (on_), 6) AS p90,
CASE WHEN count_if(on_) >= 30 AND sum(start) >= 5 THEN 'mature' WHEN count_if(on_) >= 8 THEN 'learning' ELSE 'sparse' END AS maturity FROM e GROUP BY 1""")
def a29_quantile_profile(spark, sf):
    q = F.percentile(F.when(F.col("on"), F.col("value")), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = _episodes(spark, sf).groupBy("key").agg(F.count_if("on").alias("samples"), F.sum("start").alias("episodes"), q.alias("q"))
    grade = F.when((F.col("samples") >= 30) & (F.col("episodes") >= 5), "mature").when(F.col("samples") >= 8, "learning").otherwise("sparse")
    return g.select("key", "samples", "episodes", *[R(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], grade.alias("maturity"))


_SPLIT = """v AS (SELECT user_id AS key, value AS v FROM events), g AS (SELECT key, v, lead(v) OVER (PARTITION BY key ORDER BY v) - v AS gap FROM v),
cut AS (SELECT key, arg_max(v + gap / 2, (gap, -v)) AS cut, max(gap) AS gap FROM g GROUP BY 1)"""


@query(f"WITH {_SPLIT} SELECT key, round(cut, 6) AS cut, round(gap, 6) AS gap FROM cut WHERE gap IS NOT NULL")
def e16_largest_gap(spark, sf):
    c = widest_gap(events(spark, sf).withColumnRenamed("user_id", "key"), ["key"], "value").where("gap IS NOT NULL")
    return c.select("key", R(F.col("low") + F.col("gap") / 2).alias("cut"), R("gap").alias("gap"))


@query("""WITH p AS (SELECT user_id, event_type, avg(value) AS mu, var_pop(value) AS s2, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS w FROM p),
m AS (SELECT user_id, sum(w * mu) AS mean FROM w GROUP BY 1) SELECT w.user_id, round(mean, 8) AS mean, round(sum(w.w * (s2 + (mu - mean) * (mu - mean))), 6) AS variance FROM w JOIN m ON w.user_id = m.user_id GROUP BY 1, mean""")
def a32_mixture_moments(spark, sf):
    p = events(spark, sf).groupBy("user_id", "event_type").agg(F.avg("value").alias("mu"), F.var_pop("value").alias("s2"), F.count(F.lit(1)).alias("n"))
    w = F.col("n")
    g = p.groupBy("user_id").agg((F.sum(w * F.col("mu")) / F.sum(w)).alias("mean"), (F.sum(w * (F.col("s2") + F.col("mu") * F.col("mu"))) / F.sum(w)).alias("second"))
    return g.select("user_id", R("mean", 8).alias("mean"), R(F.col("second") - F.col("mean") * F.col("mean")).alias("variance"))


@query(f"WITH {WIDE15} SELECT CAST(time AS DATE) AS day, count(*) AS n, round(CASE WHEN count(*) >= 4 THEN median(view) END, 6) AS baseline FROM wide15 WHERE click <= 30 AND (error IS NULL OR error < 40) AND view IS NOT NULL GROUP BY 1")
def a36_clean_baseline(spark, sf):
    w = wide15(spark, sf).where("click <= 30 AND (error IS NULL OR error < 40) AND view IS NOT NULL")
    return w.groupBy(F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("n"), R(F.when(F.count(F.lit(1)) >= 4, F.median("view"))).alias("baseline"))


@query(f"""WITH g AS (SELECT CAST(ts AS DATE) AS day, max(abs(value - 20)) AS diff, count(*) AS n, count_if(event_type = 'error') AS bad FROM events GROUP BY 1),
s AS (SELECT count(*) AS days, CAST(sum(n) AS BIGINT) AS n, max(diff) AS max_diff, CAST(sum(bad) AS BIGINT) AS bad FROM g) SELECT days, n, round(max_diff, 6) AS max_diff,
concat_ws(',', CASE WHEN days < 7 THEN 'short' END, CASE WHEN max_diff > 100 THEN 'difference' END, CASE WHEN bad > n / 10 THEN 'errors' END) AS failed FROM s""")
def a37_gate_verdict(spark, sf):
    s = events(spark, sf).agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("value") - 20)).alias("max_diff"), F.count_if(F.col("event_type") == "error").alias("bad"))
    why = F.concat_ws(",", F.when(F.col("days") < 7, "short"), F.when(F.col("max_diff") > 100, "difference"), F.when(F.col("bad") > F.col("n") / 10, "errors"))
    return s.select("days", "n", R("max_diff").alias("max_diff"), why.alias("failed"))


@query("""WITH z AS (SELECT user_id, max(ts) AS z FROM events GROUP BY 1), r AS (SELECT e.user_id, e.event_type, median(value) AS w, avg(CASE WHEN value > 10 THEN 1.0::DOUBLE ELSE 0 END) AS st FROM events e JOIN z ON e.user_id = z.user_id WHERE ts > z - INTERVAL 3 day GROUP BY 1, 2)
SELECT user_id, count_if(w >= 5 OR (w IS NULL AND st >= 0.5)) AS active, round(sum(CASE WHEN w >= 5 THEN w ELSE 0 END), 6) AS watts FROM r GROUP BY 1""")
def a38_outlet_activity(spark, sf, days=3):
    e = events(spark, sf)
    z = e.groupBy("user_id").agg(F.max("ts").alias("z"))
    r = e.join(z, "user_id").where(F.col("ts") > F.col("z") - F.make_dt_interval(F.lit(days))).groupBy("user_id", "event_type").agg(F.median("value").alias("w"), F.avg((F.col("value") > 10).cast("double")).alias("st"))
    on = F.when(F.col("w").isNotNull(), F.col("w") >= 5).otherwise(F.col("st") >= 0.5)
    return r.groupBy("user_id").agg(F.count_if(on).alias("active"), R(F.sum(F.when(F.col("w") >= 5, F.col("w")).otherwise(0.0))).alias("watts"))


@query("""WITH i AS (SELECT user_id AS key, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS z, value > 15 AS on_, value AS w FROM events),
d AS (SELECT key, on_, w, a, z, unnest(generate_series(date_trunc('day', a), date_trunc('day', z), INTERVAL 1 day)) AS day FROM i WHERE z IS NOT NULL AND z > a),
o AS (SELECT *, greatest(0, epoch_us(least(z, day + INTERVAL 1 day)) - epoch_us(greatest(a, day))) / 3600000000.0::DOUBLE AS h FROM d)
SELECT key, CAST(day AS DATE) AS day, round(coalesce(sum(h) FILTER (on_), 0), 6) AS on_hours, round(coalesce(sum(h) FILTER (NOT on_), 0), 6) AS idle_hours, round(sum(h * w) / 1000, 6) AS kwh FROM o GROUP BY 1, 2 HAVING sum(h) > 0""")
def a39_daily_operating(spark, sf):
    """Intervals to the next sample, split at midnight."""
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").alias("a"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")).alias("z"), (F.col("value") > 15).alias("on"), F.col("value").alias("w")).where("z > a")
    d = e.withColumn("day", F.explode(F.sequence(F.to_date("a"), F.to_date("z")))).withColumn("d0", F.col("day").cast("timestamp_ntz"))
    h = F.greatest(F.lit(0), micros(F.least("z", F.col("d0") + F.make_dt_interval(F.lit(1)))) - micros(F.greatest("a", "d0"))) / HOUR
    g = d.withColumn("h", h).groupBy("key", "day").agg(F.sum(F.when(F.col("on"), F.col("h")).otherwise(0.0)).alias("on_h"), F.sum(F.when(~F.col("on"), F.col("h")).otherwise(0.0)).alias("idle"), (F.sum(F.col("h") * F.col("w")) / 1000).alias("kwh"), F.sum("h").alias("h"))
    return g.where("h > 0").select("key", "day", R("on_h").alias("on_hours"), R("idle").alias("idle_hours"), R("kwh").alias("kwh"))


@query("""WITH i AS (SELECT user_id AS key, value > 15 AS on_, lag(value > 15) OVER w AS p, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 3600000000.0::DOUBLE AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT key, round(coalesce(sum(h) FILTER (on_), 0), 6) AS hours_on, count_if(on_ AND NOT coalesce(p, false)) AS starts FROM i GROUP BY 1""")
def a40_hours_and_starts(spark, sf):
    w = so.ordered("key", "ts")
    i = events(spark, sf).select(F.col("user_id").alias("key"), "ts", (F.col("value") > 15).alias("on")).withColumns({"p": F.coalesce(F.lag("on").over(w), F.lit(False)), "h": (F.lead(micros("ts")).over(w) - micros("ts")) / HOUR})
    return i.groupBy("key").agg(R(F.coalesce(F.sum(F.when(F.col("on"), F.col("h"))), F.lit(0.0))).alias("hours_on"), F.count_if(F.col("on") & ~F.col("p")).alias("starts"))


@query(f"WITH {WIDE15}, l AS (" + " UNION ALL ".join(f"SELECT '{t}' AS variable, {t} AS v FROM wide15" for t in TYPES) + ") SELECT variable, count(v) AS n, round(min(v), 6) AS low, round(avg(v), 6) AS mean, round(max(v), 6) AS high FROM l GROUP BY 1")
def a42_variable_stats(spark, sf):
    l = wide15(spark, sf).unpivot("time", list(TYPES), "variable", "v")  # noqa: E741
    return l.groupBy("variable").agg(F.count("v").alias("n"), R(F.min("v")).alias("low"), R(F.avg("v")).alias("mean"), R(F.max("v")).alias("high"))


@query("SELECT event_type, count_if(value > 30) AS high, count_if(value <= 30) AS low FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 hour GROUP BY 1")
def a43_event_counters(spark, sf):
    e = events(spark, sf)
    newest = e.agg(F.max("ts").alias("z"))
    return e.crossJoin(F.broadcast(newest)).where(F.col("ts") > F.col("z") - F.make_dt_interval(F.lit(1))).groupBy("event_type").agg(F.count_if(F.col("value") > 30).alias("high"), F.count_if(F.col("value") <= 30).alias("low"))


@query("SELECT CAST(ts AS DATE) AS day, min(ts) AS first, max(ts) AS last, count(*) AS n, max(value) AS high, max(value) FILTER (event_type = 'error') AS high_error FROM events GROUP BY 1")
def a44_day_extremes(spark, sf):
    return events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.max("value").alias("high"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("high_error"))


@query("""WITH s AS (SELECT user_id, event_type, CASE WHEN epoch_us(max(ts)) < epoch_us(TIMESTAMP '2024-01-10') THEN NULL ELSE arg_max(value, ts) <= 40 END AS ok FROM events GROUP BY 1, 2),
g AS (SELECT user_id, CASE WHEN count_if(event_type = 'view' AND NOT ok) > 0 THEN 'red' WHEN count_if(event_type = 'view' AND ok) > 0 THEN 'green' ELSE 'unknown' END AS source_level, CASE WHEN count_if(event_type <> 'view' AND NOT ok) > 0 THEN 'red' WHEN count_if(event_type <> 'view' AND ok) > 0 THEN 'green' ELSE 'unknown' END AS service_level,
count_if(event_type <> 'view' AND ok) AS healthy, count_if(event_type <> 'view') AS services, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (event_type <> 'view' AND NOT ok), '') AS failed, list(event_type ORDER BY event_type) FILTER (event_type <> 'view' AND NOT ok) AS bad FROM s GROUP BY 1),
r AS (SELECT *, CASE WHEN 'red' IN (source_level, service_level) THEN 'red' WHEN 'green' IN (source_level, service_level) THEN 'green' ELSE 'unknown' END AS level FROM g), c AS (SELECT count_if(source_level = 'red') AS s, count_if(level = 'red' AND source_level <> 'red') AS p FROM r)
SELECT 'stream' AS section, CAST(user_id AS VARCHAR) AS name, level, source_level, service_level, healthy, services, failed, CASE WHEN source_level = 'red' THEN 'Source is unhealthy' WHEN len(bad) > 0 THEN 'Unhealthy: ' || array_to_string(bad[1:3], ', ') WHEN level = 'green' THEN 'Source and services healthy' ELSE 'No current status' END AS detail, NULL AS streams FROM r
UNION ALL SELECT 'cause', 'source', CASE WHEN s > 0 THEN 'red' ELSE 'green' END, NULL, NULL, NULL, NULL, NULL, NULL, s FROM c UNION ALL SELECT 'cause', 'processing', CASE WHEN p > 0 THEN 'red' ELSE 'green' END, NULL, NULL, NULL, NULL, NULL, NULL, p FROM c""")
def a45_stream_health(spark, sf):
    """Each site's source and services by their newest state, which isn't known if it is old; and the root causes."""
    newest = events(spark, sf).groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("v"), F.max("ts").alias("at"))
    known = F.col("at") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    states = newest.select(F.col("user_id").cast("string").alias("stream"), F.when(F.col("event_type") == "view", "source").otherwise("service").alias("role"), F.col("event_type").alias("name"), F.when(known, F.col("v") <= 40).alias("ok"))
    streams = kept(health.stream_health(states), "streams")
    causes = health.root_causes(streams).select(F.lit("cause").alias("section"), F.col("cause").alias("name"), "level", "streams")
    return streams.withColumnRenamed("stream", "name").withColumn("section", F.lit("stream")).unionByName(causes, allowMissingColumns=True).select("section", "name", "level", "source_level", "service_level", "healthy", "services", "failed", "detail", "streams")


@query("SELECT CAST(ts AS DATE) AS day, count_if(event_type = 'error') AS blocked, count_if(event_type = 'signup') AS diagnostic, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a46_review_queue(spark, sf):
    return events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("blocked"), F.count_if(F.col("event_type") == "signup").alias("diagnostic"), R(F.avg("value")).alias("mean"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-25' GROUP BY 1 HAVING count(*) >= 2")
def a47_complete_days(spark, sf, today="2024-01-25"):
    return events(spark, sf).where(F.to_date("ts") < F.lit(today).cast("date")).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""WITH l AS (SELECT event_type AS label, median(value) AS level FROM events GROUP BY 1), u AS (SELECT user_id, median(value) AS v FROM events GROUP BY 1),
c AS (SELECT user_id, v, arg_min(label, (abs(v - level), label)) AS label, min(abs(v - level)) AS d, arg_min(level, (abs(v - level), label)) AS level FROM u, l GROUP BY 1, 2)
SELECT user_id, CASE WHEN d <= greatest(2, 0.2 * level) THEN label WHEN v > 50 THEN 'high' ELSE 'unknown' END AS label FROM c""")
def a48_nearest_level(spark, sf):
    """Each site against the learned levels, of which there is one per kind of event."""
    e = events(spark, sf)
    levels = e.groupBy(F.col("event_type").alias("label")).agg(F.median("value").alias("level"))
    listed = levels.agg(F.collect_list(F.struct("label", "level")).alias("levels"))
    u = e.groupBy("user_id").agg(F.median("value").alias("v")).crossJoin(F.broadcast(listed))
    near = F.array_min(F.transform("levels", lambda x: F.struct(F.abs(F.col("v") - x["level"]).alias("d"), x["label"].alias("label"), x["level"].alias("level"))))
    return u.withColumn("near", near).select("user_id", F.when(F.col("near.d") <= F.greatest(F.lit(2.0), 0.2 * F.col("near.level")), F.col("near.label")).when(F.col("v") > 50, "high").otherwise("unknown").alias("label"))


@query("SELECT min(z) AS common_end FROM (SELECT event_type, max(ts) AS z FROM events GROUP BY 1)")
def a50_common_end(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.max("ts").alias("z")).agg(F.min("z").alias("common_end"))


@query("""WITH c AS (SELECT user_id, count_if(event_type = 'error' AND value > 30) AS gaps, count_if(event_type = 'error' AND value > 60) AS big, arg_max(event_type, ts) AS last FROM events GROUP BY 1)
SELECT user_id, CASE WHEN gaps = 0 AND big = 0 AND last <> 'error' THEN 'amber' WHEN big > 0 THEN 'red' ELSE 'gray' END AS status FROM c""")
def a51_evidence_status(spark, sf):
    err = F.col("event_type") == "error"
    c = events(spark, sf).groupBy("user_id").agg(F.count_if(err & (F.col("value") > 30)).alias("gaps"), F.count_if(err & (F.col("value") > 60)).alias("big"), F.max_by("event_type", "ts").alias("last"))
    return c.select("user_id", F.when((F.col("gaps") == 0) & (F.col("big") == 0) & (F.col("last") != "error"), "amber").when(F.col("big") > 0, "red").otherwise("gray").alias("status"))


@query("""SELECT key, time FROM (SELECT user_id AS key, ts AS time, event_type, lag(event_type) OVER w AS p, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
WHERE p IS NULL OR p <> event_type OR d > 86400000000""")
def e12_run_starts(spark, sf):
    """First samples of the runs of a label, broken also by gaps of more than a day."""
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), "event_type")
    return so.islands(e, "key", "time", "event_type", 24 * HOUR).groupBy("key", "run").agg(F.min("time").alias("time")).select("key", "time")


_LIST_MEDIAN = lambda c: (F.get(F.array_sort(c), F.floor((F.size(c) - 1) / 2).cast("int")) + F.get(F.array_sort(c), F.floor(F.size(c) / 2).cast("int"))) / 2


@query("""WITH l AS (SELECT user_id AS key, ts, ['low', 'mid', 'high'][CASE WHEN abs(value - 5) <= least(abs(value - 20), abs(value - 60)) THEN 1 WHEN abs(value - 20) <= abs(value - 60) THEN 2 ELSE 3 END] AS label FROM events),
i AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY key ORDER BY ts) THEN 1 ELSE 0 END AS ch FROM l), r AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM i),
n AS (SELECT *, count(*) OVER (PARTITION BY key, run) AS n, count(*) OVER (PARTITION BY key) AS whole, max(CASE WHEN run = 2 THEN label END) OVER (PARTITION BY key) AS second FROM r)
SELECT key, ts, CASE WHEN whole < 3 THEN label ELSE coalesce(last_value(CASE WHEN n >= 2 THEN label END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING), second, label) END AS label FROM n""")
def e18_debounced_label(spark, sf):
    """Each value's nearest centre, the first of two alike; single samples take the label before them, leading ones the one after."""
    centres = {"low": 5.0, "mid": 20.0, "high": 60.0}
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("value") - c).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("label")) for i, (n, c) in enumerate(centres.items())]))
    l = events(spark, sf).select(F.col("user_id").alias("key"), "ts", near["label"].alias("label"))  # noqa: E741
    return debounced(l, ["key"], "ts", "label").select("key", "ts", "label")


@query("""WITH z AS (SELECT user_id, max(ts) FILTER (event_type = 'signup') AS opp FROM events GROUP BY 1), c AS (SELECT e.user_id, value, ts, max(ts) OVER (PARTITION BY e.user_id) AS last FROM events e JOIN z ON e.user_id = z.user_id WHERE opp IS NULL OR ts > opp)
SELECT user_id, count(*) AS n, round(coalesce(median(value) FILTER (ts > last - INTERVAL 2 day), median(value), 0), 6) AS level FROM c GROUP BY 1""")
def e20_current_run(spark, sf):
    e = events(spark, sf)
    c = e.withColumn("opp", F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(Window.partitionBy("user_id"))).where("opp IS NULL OR ts > opp")
    c = c.withColumn("last", F.max("ts").over(Window.partitionBy("user_id")))
    recent = F.median(F.when(F.col("ts") > F.col("last") - F.make_dt_interval(F.lit(2)), F.col("value")))
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), R(F.coalesce(recent, F.median("value"), F.lit(0.0))).alias("level"))


@query("""WITH s AS (SELECT event_type AS mode, value AS v, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events), c AS (SELECT event_type AS mode, median(value) AS clean FROM events WHERE value < 60 GROUP BY 1),
k AS (SELECT s.mode, v, ts FROM s JOIN c ON s.mode = c.mode WHERE abs(v - clean) <= greatest(10, 0.35 * clean) UNION ALL SELECT mode, clean, (SELECT max(ts) FROM events) + INTERVAL 1 hour FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY ts DESC, v) AS r FROM k) SELECT mode, count(*) AS n, round(median(v), 6) AS level FROM t WHERE r <= 168 GROUP BY 1""")
def e46_registry_repair(spark, sf, keep=168):
    e = events(spark, sf).select(F.col("event_type").alias("mode"), F.col("value").alias("v"), "ts")
    clean = e.where("v < 60").groupBy("mode").agg(F.median("v").alias("clean"))
    newest = e.agg((F.max("ts") + F.make_dt_interval(hours=F.lit(1))).alias("ts"))
    kept = e.join(clean, "mode").where(F.abs(F.col("v") - F.col("clean")) <= F.greatest(F.lit(10.0), 0.35 * F.col("clean"))).select("mode", "v", "ts")
    t = kept.union(clean.crossJoin(newest).select("mode", F.col("clean").alias("v"), "ts")).withColumn("r", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("ts"), "v"))).where(F.col("r") <= keep)
    return t.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), R(F.median("v")).alias("level"))


@query("SELECT count_if(ch AND NOT st) AS violations, count(*) AS n FROM (SELECT value <> lag(value) OVER w AS ch, event_type <> lag(event_type) OVER w AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))")
def e40_state_invariance(spark, sf):
    c = blocks.before(events(spark, sf).select("user_id", "ts", "value", "event_type"), "user_id", "ts", ["value", "event_type"])
    c = c.select((F.col("value") != F.col("_before.value")).alias("ch"), (F.col("event_type") != F.col("_before.event_type")).alias("st"))
    return c.agg(F.count_if(F.col("ch") & ~F.col("st")).alias("violations"), F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT user_id AS key, ts, event_type AS g, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 1 ELSE 0 END AS ch FROM events),
r AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM i) SELECT key, ts FROM r QUALIFY run = max(run) OVER (PARTITION BY key)""")
def e42_latest_geometry_run(spark, sf):
    r = so.islands(events(spark, sf).select(F.col("user_id").alias("key"), "ts", "event_type"), "key", "ts", "event_type")
    return r.join(r.groupBy("key").agg(F.max("run").alias("run")), ["key", "run"]).select("key", "ts")


@query(f"""WITH {_EPISODE}, q AS (SELECT key, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM e GROUP BY 1) SELECT count_if(NOT (p10 <= p50 AND p50 <= p90)) AS violations, count(*) AS n FROM q""")
def e43_quantile_order(spark, sf):
    q = events(spark, sf).groupBy("user_id").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.agg(F.count_if(~((F.col("q")[0] <= F.col("q")[1]) & (F.col("q")[1] <= F.col("q")[2]))).alias("violations"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MEDIA} SELECT media_type, event_id FROM media QUALIFY row_number() OVER (PARTITION BY media_type ORDER BY time DESC) <= 5""")
def e28_latest_records(spark, sf, n=5):
    m = media(spark, sf)
    return m.withColumn("rn", F.row_number().over(Window.partitionBy("media_type").orderBy(F.desc("time")))).where(F.col("rn") <= n).select("media_type", "event_id")


@query(f"WITH {MEDIA} SELECT media_type, day, event_id FROM media QUALIFY row_number() OVER (PARTITION BY media_type, day ORDER BY CASE kind WHEN 'video' THEN 0 ELSE 1 END, time DESC) = 1")
def e29_preferred_kind(spark, sf):
    rank = F.when(F.col("kind") == "video", 0).otherwise(1)
    return media(spark, sf).groupBy("media_type", "day").agg(F.min_by("event_id", F.struct(rank, -micros("time"))).alias("event_id"))


@query(f"""WITH {MEDIA}, m AS (SELECT *, date_trunc('hour', time) AS hour, epoch_us(time) % 3600000000 AS u FROM media) SELECT media_type, hour, event_id FROM m QUALIFY row_number() OVER (PARTITION BY media_type, hour ORDER BY abs(u // 1000000 - 1800), u // 1000000, u) = 1""")
def e30_hourly_representative(spark, sf):
    m = media(spark, sf).withColumns({"hour": F.date_trunc("hour", "time").cast("timestamp_ntz"), "u": micros("time") % HOUR})
    sec = F.expr("u div 1000000")
    return m.groupBy("media_type", "hour").agg(F.min_by("event_id", F.struct(F.abs(sec - 1800), sec, F.col("u"))).alias("event_id"))


@query(f"WITH {WIDE15} SELECT " + ", ".join(f"round(arg_max({t}, time) FILTER ({t} IS NOT NULL), 6) AS {t}, max(time) FILTER ({t} IS NOT NULL) AS {t}_at" for t in TYPES) + ", max(time) FILTER (click IS NOT NULL AND error IS NOT NULL AND view IS NOT NULL) AS whole_at FROM wide15")
def e31_latest_finite(spark, sf):
    at = lambda c: F.when(c.isNotNull(), F.col("time"))
    cols = [x for t in TYPES for x in (R(F.max_by(t, at(F.col(t)))).alias(t), F.max(at(F.col(t))).alias(f"{t}_at"))]
    whole = F.max(F.when(F.col("click").isNotNull() & F.col("error").isNotNull() & F.col("view").isNotNull(), F.col("time")))
    return wide15(spark, sf).agg(*cols, whole.alias("whole_at"))


@query(f"""WITH {OBSERVED}, s AS (SELECT time, obs, time - INTERVAL 15 minute AS a FROM observed WHERE obs > 40), f AS (SELECT min(time) AS t FROM s), g AS (SELECT (SELECT t FROM f) AS first_high, (SELECT min(time) FROM observed) AS first) SELECT coalesce(first_high, first) AS start, first_high IS NOT NULL AS found FROM g""")
def e45_first_forecast_start(spark, sf):
    o = observed(spark, sf)
    first = F.min(F.when(F.col("obs") > 40, F.col("time")))
    return o.agg(F.coalesce(first, F.min("time")).alias("start"), first.isNotNull().alias("found"))
