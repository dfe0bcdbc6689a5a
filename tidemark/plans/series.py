"""Buckets, gaps, rolling means, as-of joins, interpolation, downsampling and folds of series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.times import DAY, HOUR, MINUTE, SECOND, bucket, micros
from ..operators import grids, health
from ..operators import series as op
from ..registry import query
from ..sources.bindings import COUNTERS, OBSERVED, SERIES, WIDE15, counters, events, observed, series, table, wide15
from ..sources.listing import changed, listing
from ..sources.scratch import folder
from ..sources.scratch import table as kept


@query(f"WITH {SERIES} SELECT key, time_bucket(INTERVAL 1 minute, time) AS time, round(avg(v), 6) AS v FROM series GROUP BY 1, 2")
def a1_bucket_mean(spark, sf):
    return series(spark, sf).groupBy("key", bucket("time", 1).alias("time")).agg(F.round(F.avg("v"), 6).alias("v"))


@query(f"WITH {SERIES} SELECT key, time_bucket(INTERVAL 15 minute, time) AS time, round(median(v), 6) AS v FROM series GROUP BY 1, 2")
def a2_bucket_median(spark, sf):
    return series(spark, sf).groupBy("key", bucket("time", 15).alias("time")).agg(F.round(F.median("v"), 6).alias("v"))


@query(f"WITH {SERIES} SELECT key, time_bucket(INTERVAL 30 minute, time) AS time, arg_max(v, time) AS v FROM series WHERE v > 5 GROUP BY 1, 2")
def a3_bucket_last(spark, sf):
    v = F.when(F.col("v") > 5, F.col("v"))
    g = series(spark, sf).groupBy("key", bucket("time", 30).alias("time")).agg(F.max_by(v, F.when(v.isNotNull(), F.col("time"))).alias("v"))
    return g.where("v IS NOT NULL")


def _grid(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("time"), F.col("l_linenumber").alias("gate")).agg(F.avg("l_quantity").alias("v"))


@query("""WITH g AS (SELECT CAST(l_shipdate AS DATE) AS time, l_linenumber AS gate, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
t AS (SELECT time, (row_number() OVER (ORDER BY time) - 1) // 7 AS b, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM g)),
h AS (SELECT gate, (row_number() OVER (ORDER BY gate) - 1) // 2 AS b, count(*) OVER () AS n FROM (SELECT DISTINCT gate FROM g)),
tc AS (SELECT time, CAST(sum(epoch_us(time)) OVER w // count(*) OVER w AS BIGINT) AS c FROM t WHERE (b + 1) * 7 <= n WINDOW w AS (PARTITION BY b)),
hc AS (SELECT gate, avg(gate) OVER (PARTITION BY b) AS c FROM h WHERE (b + 1) * 2 <= n), m AS (SELECT time, hc.c AS gate, avg(v) AS v FROM g JOIN hc USING (gate) GROUP BY 1, 2)
SELECT make_timestamp(tc.c) AS time, m.gate, round(avg(v), 6) AS v FROM m JOIN tc ON m.time = tc.time GROUP BY 1, 2""")
def a4_coarsen(spark, sf, by_time=7, by_gate=2):
    """Means of blocks of consecutive gates, then times; incomplete blocks at the ends are dropped."""
    return grids.coarsen(_grid(spark, sf), "v", {"gate": by_gate, "time": by_time}).withColumn("v", F.round("v", 6))


@query(f"""WITH {COUNTERS}, c AS (SELECT *, CASE WHEN epoch_us(time) // 1000000 % 11 <> 0 THEN counter END AS c, CAST(time AS DATE) AS day FROM counters),
p AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY key, day ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c)
SELECT key, time, CASE WHEN c IS NOT NULL THEN CAST(sum(CASE WHEN c IS NOT NULL THEN coalesce(greatest(c - prev, 0), 0) END) OVER (PARTITION BY key, day ORDER BY time ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS total FROM p""")
def e4_counter_delta(spark, sf):
    c = counters(spark, sf).withColumn("c", F.when(F.expr(f"unix_micros(cast(time as timestamp)) div {SECOND} % 11 <> 0"), F.col("counter")))
    return op.counter_delta(c, "key", "time", "c").select("key", "time", "total")


@query(f"""WITH {SERIES}, p AS (SELECT *, CAST(time AS DATE) AS day, greatest(v - 5, 0) AS p FROM series),
e AS (SELECT *, coalesce((p + lag(p) OVER w) / 2 * (epoch_us(time) - lag(epoch_us(time)) OVER w) / 3600000000 / 1000, 0) AS e FROM p WINDOW w AS (PARTITION BY key, day ORDER BY time))
SELECT key, time, round(sum(e) OVER (PARTITION BY key, day ORDER BY time ROWS UNBOUNDED PRECEDING), 6) AS kwh FROM e""")
def e5_energy(spark, sf):
    return op.trapezoid_energy(series(spark, sf), "key", "time", F.greatest(F.col("v") - 5, F.lit(0.0))).select("key", "time", F.round("kwh", 6).alias("kwh"))


@query(f"WITH {COUNTERS} SELECT key, time, round(greatest(0, (counter - lag(counter) OVER w) / ((epoch_us(time) - lag(epoch_us(time)) OVER w) / 1000000.0::DOUBLE)), 6) AS rate FROM counters WINDOW w AS (PARTITION BY key ORDER BY time)")
def e7_rate(spark, sf):
    return op.rate(counters(spark, sf), "key", "time", "counter").select("key", "time", F.round("rate", 6).alias("rate"))


_CADENCE = f"""{SERIES}, d AS (SELECT key, time, epoch_us(time) AS t, epoch_us(time) - lag(epoch_us(time)) OVER w AS back, lead(epoch_us(time)) OVER w - epoch_us(time) AS d FROM series WINDOW w AS (PARTITION BY key ORDER BY time)),
c AS (SELECT key, CAST(trunc(median(back)) AS BIGINT) AS cadence FROM d WHERE back > 0 GROUP BY 1)"""


@query(f"""WITH {_CADENCE}, g AS (SELECT d.key, t, d, least(cadence, greatest(1, d // 3)) AS pad FROM d JOIN c ON d.key = c.key WHERE d > greatest(floor(cadence * 3.5), 60000000))
SELECT key, unnest(CASE WHEN t + pad < t + d - pad THEN [t + pad, t + d - pad] ELSE [t + d // 2] END) AS time_us FROM g""")
def e8_gap_markers(spark, sf):
    return op.gap_markers(series(spark, sf), "key", "time")


@query(f"""WITH {_CADENCE} SELECT d.key, time, CAST(sum(CASE WHEN back > greatest(cadence * 4.0, 300000000) THEN 1 ELSE 0 END) OVER (PARTITION BY d.key ORDER BY time ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM d LEFT JOIN c ON d.key = c.key""")
def e9_segments(spark, sf):
    return op.segments(series(spark, sf), "key", "time").select("key", "time", "segment")


@query(f"WITH {SERIES} SELECT key, date_trunc('day', time) AS time FROM series QUALIFY CAST(time AS DATE) <> lag(CAST(time AS DATE)) OVER (PARTITION BY key ORDER BY time)")
def e10_day_breaks(spark, sf):
    return op.day_breaks(series(spark, sf), "key", "time")


@query(f"WITH {SERIES} SELECT key, time, round(avg(v) OVER (PARTITION BY key ORDER BY epoch_us(time) RANGE BETWEEN 899999999 PRECEDING AND 900000000 FOLLOWING), 6) AS mean FROM series")
def e11_rolling_mean(spark, sf):
    return op.rolling_mean(series(spark, sf), "key", "time", "v").select("key", "time", F.round("mean", 6).alias("mean"))


@query(f"""WITH {WIDE15}, a AS (SELECT time, click, error FROM wide15 WHERE click IS NOT NULL), b AS (SELECT time, view AS click, purchase FROM wide15 WHERE view IS NOT NULL)
SELECT coalesce(a.time, b.time) AS time, round(coalesce(a.click, b.click), 6) AS click, round(error, 6) AS error, round(purchase, 6) AS purchase FROM a FULL JOIN b ON a.time = b.time""")
def j1_priority_fill(spark, sf):
    w = wide15(spark, sf)
    a, b = w.where("click IS NOT NULL").select("time", "click", "error"), w.where("view IS NOT NULL").select("time", F.col("view").alias("click"), "purchase")
    j = a.alias("a").join(b.alias("b"), "time", "fullouter")
    return j.select("time", F.round(F.coalesce("a.click", "b.click"), 6).alias("click"), F.round("error", 6).alias("error"), F.round("purchase", 6).alias("purchase"))


@query(f"""WITH {WIDE15}, l AS (SELECT time, 1 AS src, 'x' AS name, click AS v FROM wide15 UNION ALL SELECT time, 2, 'x', view FROM wide15 WHERE view IS NOT NULL UNION ALL SELECT time, 1, 'y', error FROM wide15),
r AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY time, name ORDER BY src DESC) = 1)
SELECT time, round(max(v) FILTER (name = 'x'), 6) AS x, round(max(v) FILTER (name = 'y'), 6) AS y FROM r GROUP BY 1 HAVING count(v) > 0""")
def j2_concat_last_wins(spark, sf):
    w = wide15(spark, sf)
    part = lambda src, name, c: w.select("time", F.lit(src).alias("src"), F.lit(name).alias("name"), F.col(c).alias("v"))
    long = part(1, "x", "click").union(part(2, "x", "view").where("v IS NOT NULL")).union(part(1, "y", "error"))
    last = long.groupBy("time", "name").agg(F.max_by("v", "src").alias("v"))
    wide = last.groupBy("time").agg(*[F.round(F.max(F.when(F.col("name") == n, F.col("v"))), 6).alias(n) for n in "xy"])
    return wide.dropna(how="all", subset=["x", "y"])


@query(f"""WITH {WIDE15} SELECT coalesce(a.time, b.time) AS time, round(a.click, 6) AS click, round(b.view, 6) AS plan FROM (SELECT time, click FROM wide15 WHERE click IS NOT NULL) a
FULL JOIN (SELECT time, view FROM wide15 WHERE view IS NOT NULL) b ON a.time = b.time""")
def j3_replace_stale(spark, sf):
    """The old plan's column is dropped before the authoritative one is merged in."""
    w = wide15(spark, sf)
    old = w.where("click IS NOT NULL").select("time", "click", F.lit(0.0).alias("plan"))
    new = w.where("view IS NOT NULL").select("time", F.col("view").alias("plan"))
    return old.drop("plan").join(new, "time", "fullouter").select("time", F.round("click", 6).alias("click"), F.round("plan", 6).alias("plan"))


@query(f"""WITH {WIDE15} SELECT round(max(abs(a.click - b.view)), 6) AS max_diff, round(avg(abs(a.click - b.view)), 6) AS mean_diff, count(*) AS n
FROM wide15 a JOIN wide15 b ON a.time = b.time WHERE a.click IS NOT NULL AND b.view IS NOT NULL""")
def j4_aligned_difference(spark, sf):
    w = wide15(spark, sf)
    j = w.where("click IS NOT NULL").select("time", "click").join(w.where("view IS NOT NULL").select("time", "view"), "time")
    d = F.abs(F.col("click") - F.col("view"))
    return j.agg(F.round(F.max(d), 6).alias("max_diff"), F.round(F.avg(d), 6).alias("mean_diff"), F.count(F.lit(1)).alias("n"))


_PROBE = "probe AS (SELECT user_id AS key, ts AS time, event_id FROM events WHERE event_type = 'click'), sample AS (SELECT user_id AS key, ts AS time, value AS v FROM events WHERE event_type = 'view')"


def _probe(spark, sf):
    e = events(spark, sf)
    return e.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("ts").alias("time"), "event_id"), e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("time"), F.col("value").alias("v"))


@query(f"""WITH {_PROBE}, b AS (SELECT p.*, s.v AS bv, epoch_us(p.time) - epoch_us(s.time) AS bd FROM probe p ASOF LEFT JOIN sample s ON p.key = s.key AND p.time >= s.time),
n AS (SELECT b.*, s.v AS nv, epoch_us(s.time) - epoch_us(b.time) AS nd FROM b ASOF LEFT JOIN sample s ON b.key = s.key AND b.time <= s.time),
q AS (SELECT *, nd IS NOT NULL AND (bd IS NULL OR nd <= bd) AS later FROM n)
SELECT event_id, CASE WHEN least(bd, nd) <= 7200000000 THEN CASE WHEN later THEN nv ELSE bv END END AS v_match FROM q""")
def j5_nearest_asof(spark, sf):
    probe, sample = _probe(spark, sf)
    return op.asof(probe, sample, "key", "time", "v", 2 * HOUR).select("event_id", "v_match")


@query(f"""WITH {_PROBE} SELECT event_id, CASE WHEN epoch_us(p.time) - epoch_us(s.time) <= 1800000000 THEN s.v END AS v_match FROM probe p ASOF LEFT JOIN sample s ON p.key = s.key AND p.time >= s.time""")
def j6_backward_asof(spark, sf):
    probe, sample = _probe(spark, sf)
    return op.asof(probe, sample, "key", "time", "v", 30 * MINUTE, "backward").select("event_id", "v_match")


@query("""WITH s AS (SELECT user_id AS key, ts AS time, value > 20 AS on_ FROM events WHERE event_type = 'signup'), p AS (SELECT user_id AS key, ts AS time, event_id FROM events WHERE event_type = 'view')
SELECT event_id, coalesce(s.on_, false) AS "on" FROM p ASOF LEFT JOIN s ON p.key = s.key AND p.time >= s.time""")
def j7_step_state(spark, sf):
    e = events(spark, sf)
    at = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), "event_id", (F.col("value") > 20).cast("double").alias("v"))
    return op.asof(at("view").drop("v"), at("signup").drop("event_id"), "key", "time", "v", how="backward").select("event_id", (F.coalesce("v_match", F.lit(0.0)) > 0).alias("on"))


@query("""WITH p AS (SELECT event_id, user_id, ts, value > 20 AS expected FROM events WHERE event_type = 'signup'), s AS (SELECT user_id, ts, value > 15 AS active FROM events WHERE event_type <> 'signup')
SELECT event_id, count(s.ts) AS seen, coalesce(max(CAST(s.active = expected AS INT)), 0) AS agrees FROM p LEFT JOIN s ON p.user_id = s.user_id AND abs(epoch_us(p.ts) - epoch_us(s.ts)) <= 3600000000 GROUP BY 1""")
def j8_event_evidence(spark, sf):
    """Range join in hour cells: a sample is listed in its own cell and both neighbours, so equality does the work."""
    e = events(spark, sf)
    p = e.where("event_type = 'signup'").select("event_id", "user_id", micros("ts").alias("t"), (F.col("value") > 20).alias("expected")).withColumn("cell", F.expr(f"t div {HOUR}"))
    s = e.where("event_type <> 'signup'").select("user_id", micros("ts").alias("s"), (F.col("value") > 15).alias("active")).withColumn("cell", F.explode(F.expr(f"array(s div {HOUR} - 1, s div {HOUR}, s div {HOUR} + 1)")))
    j = p.join(s, (p.user_id == s.user_id) & (p.cell == s.cell) & (F.abs(p.t - s.s) <= HOUR), "left")
    return j.groupBy("event_id").agg(F.count("s").alias("seen"), F.coalesce(F.max((F.col("active") == F.col("expected")).cast("int")), F.lit(0)).alias("agrees"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, max(ts) AS ts FROM events GROUP BY 1, 2) SELECT e.event_id, e.event_type, d.day FROM events e JOIN d ON e.event_type = d.event_type AND e.ts = d.ts""")
def j10_latest_per_day(spark, sf):
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    top = e.groupBy("event_type", "day").agg(F.max("ts").alias("ts"))
    return e.join(top, ["event_type", "day", "ts"]).select("event_id", "event_type", "day")


@query("SELECT CAST(ts AS DATE) AS day, 'new' AS change FROM events GROUP BY 1 HAVING day(CAST(ts AS DATE)) % 3 = 0 UNION ALL SELECT CAST(ts AS DATE), 'changed' FROM events GROUP BY 1 HAVING day(CAST(ts AS DATE)) % 3 = 1")
def j11_changed_files(spark, sf):
    """A file a day is written; between two listings a third of the files change, and another third appear."""
    at = folder(spark, "files")
    e = events(spark, sf).select(F.to_date("ts").alias("day"), F.col("event_id").cast("string").alias("value")).repartition("day")
    third = F.day("day") % 3
    e.where(third != 0).write.partitionBy("day").text(at)
    known = kept(listing(spark, at, "*.txt"), "known")
    e.where(third == 0).write.mode("append").partitionBy("day").text(at)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for row in known.where(F.day(F.regexp_extract("path", "day=([0-9-]+)", 1).cast("date")) % 3 == 1).select("path").collect():  # a row a day
        p = fs.Path(row["path"])
        s = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        s.setTimes(p, s.getFileStatus(p).getModificationTime() + 60_000, -1)
    found = changed(listing(spark, at, "*.txt"), known).join(known.select("path", F.lit(True).alias("was")), "path", "left")
    return found.select(F.regexp_extract("path", "day=([0-9-]+)", 1).cast("date").alias("day"), F.when(F.col("was"), "changed").otherwise("new").alias("change")).distinct()


@query("""WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour FROM events) SELECT event_type, hour FROM h WHERE (event_type, hour) NOT IN (SELECT event_type, date_trunc('hour', ts) FROM events WHERE value > 10)""")
def j12_unpublished_hours(spark, sf):
    h = events(spark, sf).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return h.select("event_type", "hour").distinct().join(h.where("value > 10").select("event_type", "hour"), ["event_type", "hour"], "left_anti")


_HOURS = "b AS (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS z FROM events), cal AS (SELECT unnest(generate_series(a, z, INTERVAL 1 hour)) AS hour FROM b)"


def hours(spark, sf):
    e = events(spark, sf).agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("a"), F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("z"))
    return e.select(F.explode(F.sequence("a", "z", F.make_dt_interval(hours=F.lit(1)))).alias("hour"))


@query(f"""WITH {_HOURS}, t AS (SELECT DISTINCT event_type FROM events), o AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT t.event_type, cal.hour, coalesce(n, 0) AS n FROM cal CROSS JOIN t LEFT JOIN o ON o.event_type = t.event_type AND o.hour = cal.hour""")
def j13_calendar_expansion(spark, sf):
    e = events(spark, sf)
    o = e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    # the calendar has a row per hour of the span, whatever the number of events
    full = e.select("event_type").distinct().crossJoin(F.broadcast(hours(spark, sf)))
    return full.join(o, ["event_type", "hour"], "left").na.fill(0, ["n"])


@query("""SELECT event_id, coalesce(mode, 'idle') AS mode FROM events LEFT JOIN (VALUES (TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-05 00:00:00', 'heat'), (TIMESTAMP '2024-01-10 06:00:00', TIMESTAMP '2024-01-10 18:00:00', 'radar')) s(a, z, mode) ON ts >= a AND ts < z""")
def j14_schedule_mode(spark, sf):
    """Half-open intervals; a schedule is a few rows and is broadcast."""
    plan = spark.createDataFrame([("2024-01-03 00:00:00", "2024-01-05 00:00:00", "heat"), ("2024-01-10 06:00:00", "2024-01-10 18:00:00", "radar")], "a string, z string, mode string")
    plan = plan.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("z").cast("timestamp_ntz").alias("z"), "mode")
    e = events(spark, sf)
    return e.join(F.broadcast(plan), (e.ts >= plan.a) & (e.ts < plan.z), "left").select("event_id", F.coalesce("mode", F.lit("idle")).alias("mode"))


@query("SELECT e.event_type, c.c_mktsegment AS label, count(*) AS n FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey GROUP BY 1, 2")
def j16_label_lookup(spark, sf):
    """A dimension that may grow: the optimizer broadcasts it if its size allows, else it is shuffled."""
    e, c = events(spark, sf), table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return e.join(c, e.user_id == c.c_custkey, "left").groupBy("event_type", F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT o_orderkey AS k, o_totalprice AS v, 0 AS rev FROM orders UNION ALL SELECT o_orderkey, o_totalprice * 2, 1 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT -o_orderkey - 1, 1.0, 1 FROM orders WHERE o_orderkey % 50 = 0)
SELECT k, v FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY rev DESC) = 1""")
def j17_upsert(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where("k % 5 = 0").select("k", F.col("v") * 2).union(o.where("k % 50 = 0").select(-F.col("k") - 1, F.lit(1.0)))
    both = o.withColumn("rev", F.lit(0)).union(new.withColumn("rev", F.lit(1)))
    return both.groupBy("k").agg(F.max_by("v", "rev").alias("v"))


@query("""WITH s AS (SELECT user_id, arg_max(value > 30, ts) AS on_ FROM events WHERE event_type = 'signup' AND user_id % 3 <> 0 GROUP BY 1 HAVING epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) <= 864000000000), i AS (SELECT user_id, count(*) AS issues FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT i.user_id, issues FROM i LEFT JOIN s USING (user_id) WHERE s.on_ IS NULL OR s.on_""")
def j18_suppression(spark, sf):
    """An issue is held back only if its switch is known to be off, and not for longer than ten days."""
    e = events(spark, sf)
    switch = e.where("event_type = 'signup' AND user_id % 3 <> 0").withColumn("on", F.col("value") > 30)
    issues = e.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("issues"))
    return health.let_through(issues, switch, "user_id", "ts", "on", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 10 * DAY).select("user_id", "issues")


@query("""SELECT abs(epoch_us(a.t) - epoch_us(b.t)) <= 3600000000 AS compatible, epoch_us(a.t) - epoch_us(b.t) AS age_us FROM (SELECT max(ts) AS t FROM events WHERE event_type = 'click') a, (SELECT max(ts) AS t FROM events WHERE event_type = 'view') b""")
def j19_plan_anchor(spark, sf):
    e = events(spark, sf)
    newest = lambda t, c: e.where(F.col("event_type") == t).agg(micros(F.max("ts")).alias(c))
    return newest("click", "a").crossJoin(newest("view", "b")).select((F.abs(F.col("a") - F.col("b")) <= HOUR).alias("compatible"), (F.col("a") - F.col("b")).alias("age_us"))


@query("""WITH r AS (SELECT unnest([TIMESTAMP '2024-01-05 12:00:00', TIMESTAMP '2024-01-20 03:30:00']) AS want)
SELECT user_id, want, event_id FROM events, r QUALIFY row_number() OVER (PARTITION BY user_id, want ORDER BY abs(epoch_us(ts) - epoch_us(want)), ts DESC) = 1""")
def j20_nearest_record(spark, sf):
    e = events(spark, sf)
    want = F.explode(F.array(*[F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 12:00:00", "2024-01-20 03:30:00")]))
    c = e.select("user_id", "event_id", "ts", want.alias("want"))
    return c.groupBy("user_id", "want").agg(F.min_by("event_id", F.struct(F.abs(micros("ts") - micros("want")), -micros("ts"))).alias("event_id"))


@query(f"WITH {WIDE15}, f AS (SELECT count(*) FILTER (click IS NULL OR error IS NULL) = 0 AS whole FROM wide15) SELECT time, round(CASE WHEN whole THEN click ELSE view END, 6) AS v FROM wide15, f")
def j21_all_or_nothing(spark, sf):
    """The first set of fields if it is complete in every row, else the second: never a mixture."""
    w = wide15(spark, sf)
    whole = w.agg((F.count_if(F.col("click").isNull() | F.col("error").isNull()) == 0).alias("whole"))
    return w.crossJoin(F.broadcast(whole)).select("time", F.round(F.when(F.col("whole"), F.col("click")).otherwise(F.col("view")), 6).alias("v"))


@query(f"""WITH {_HOURS}, {OBSERVED}, o AS (SELECT time, obs FROM observed WHERE obs > 10), g AS (SELECT hour + INTERVAL 20 minute AS time FROM cal),
bk AS (SELECT g.time, o.time AS bt, o.obs AS bv FROM g ASOF LEFT JOIN o ON g.time >= o.time), n AS (SELECT bk.*, o.time AS nt, o.obs AS nv FROM bk ASOF LEFT JOIN o ON bk.time <= o.time)
SELECT time, round(CASE WHEN bt IS NULL THEN nv WHEN nt IS NULL OR nt = bt THEN bv ELSE bv + (epoch_us(time) - epoch_us(bt))::DOUBLE / (epoch_us(nt) - epoch_us(bt)) * (nv - bv) END, 6) AS v FROM n""")
def e32_interpolate(spark, sf):
    grid = hours(spark, sf).select(F.lit(0).alias("key"), (F.col("hour") + F.make_dt_interval(mins=F.lit(20))).alias("time"))
    samples = observed(spark, sf).where("obs > 10").select(F.lit(0).alias("key"), "time", F.col("obs").alias("v"))
    return op.interpolate(grid, samples, "key", "time", "v").select("time", F.round("v", 6).alias("v"))


@query(f"""WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM series), b AS (SELECT *, least(8, ((i + 1) * 9 - 1) // n) AS b FROM r)
SELECT key, time, v FROM b QUALIFY n <= 20 OR i = 0 OR i = n - 1 OR row_number() OVER (PARTITION BY key, b ORDER BY v, i) = 1 OR row_number() OVER (PARTITION BY key, b ORDER BY v DESC, i) = 1""")
def e36_downsample(spark, sf):
    return op.downsample(series(spark, sf), "key", "time", "v", 20)


def gapped_sql(base, markers, k):
    """CTEs mp (key, time_us: the markers that stay) and kp (key, time, v: the values that stay) of at most k rows a series."""
    return f"""mk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time_us) - 1 AS j, count(*) OVER (PARTITION BY key) AS g FROM {markers}),
mp AS (SELECT key, time_us FROM mk WHERE g <= {k - 2} OR j = 0 OR ((j * {k - 3} + g - 2) // (g - 1)) * (g - 1) // {k - 3} = j), mc AS (SELECT key, count(*) AS g FROM mp GROUP BY 1),
kr AS (SELECT b.*, row_number() OVER (PARTITION BY b.key ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY b.key) AS n, greatest(2, {k} - coalesce(g, 0)) AS fb FROM {base} b LEFT JOIN mc ON mc.key = b.key),
kb AS (SELECT *, ((i + 1) * greatest(1, (fb - 2) // 2) - 1) // n AS b FROM kr),
ks AS (SELECT * FROM kb QUALIFY n <= fb OR i = 0 OR i = n - 1 OR row_number() OVER (PARTITION BY key, b ORDER BY v, i) = 1 OR row_number() OVER (PARTITION BY key, b ORDER BY v DESC, i) = 1),
kn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY key) AS c FROM ks), kp AS (SELECT key, time, v FROM kn WHERE c <= fb OR p = 0 OR ((p * (fb - 1) + c - 2) // (c - 1)) * (c - 1) // (fb - 1) = p)"""


_GAPS = """g AS (SELECT d.key, t, d, least(cadence, greatest(1, d // 3)) AS pad FROM d JOIN c ON d.key = c.key WHERE d > greatest(floor(cadence * 3.5), 60000000)),
m AS (SELECT key, unnest(CASE WHEN t + pad < t + d - pad THEN [t + pad, t + d - pad] ELSE [t + d // 2] END) AS time_us FROM g)"""


@query(f"WITH {_CADENCE}, {_GAPS}, {gapped_sql('series', 'm', 20)} SELECT key, epoch_us(time) AS time_us, v FROM kp UNION ALL SELECT key, time_us, NULL FROM mp")
def e37_gapped_downsample(spark, sf):
    """Values and the markers of gaps, 20 rows a series together: 18 markers at most, evenly picked."""
    return op.gapped(series(spark, sf), "key", "time", "v", 20)


@query(f"WITH {SERIES} SELECT key, time, v FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM series) WHERE i % greatest(1, CAST(ceil(n / 25.0) AS BIGINT)) = 0")
def e38_stride(spark, sf, most=25):
    return op.stride(series(spark, sf), "key", "time", most).select("key", "time", "v")


@query("""WITH s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, ts AS time, value - 20 AS d FROM events),
r AS (SELECT key, list(d ORDER BY i) AS ds, list(time ORDER BY i) AS ts FROM s GROUP BY 1)
SELECT key, unnest(ts) AS time, round(unnest([list_reduce(ds[1:k], lambda x, y: least(100, greatest(0, x + y)), 50.0::DOUBLE) for k in range(1, len(ds) + 1)]), 6) AS balance FROM r""")
def e22_bounded_balance(spark, sf):
    s = series(spark, sf).withColumn("d", F.col("v") - 20)
    return op.balance_by_block(s, "key", "time", "d", F.to_date("time"), 50.0).withColumn("balance", F.round("balance", 6))


@query("""WITH s AS (SELECT user_id AS key, ts AS time, value - 12 AS e FROM events WHERE event_type = 'error'), r AS (SELECT key, list(e ORDER BY time) AS es FROM s GROUP BY 1)
SELECT key, round(list_reduce(es, lambda x, y: least(5, greatest(-5, x - 0.2 * y)), 0.0::DOUBLE), 6) AS bias FROM r""")
def e23_bias_accumulator(spark, sf, alpha=0.2, limit=5.0):
    s = events(spark, sf).where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("ts").alias("time"), (-alpha * (F.col("value") - 12)).alias("d"))
    return op.last_balance(s, "key", "time", "d", F.to_date("time"), 0.0, -limit, limit).select("key", F.round("balance", 6).alias("bias"))


@query("""WITH s AS (SELECT user_id AS key, ts AS time, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'error'),
a AS (SELECT *, least(0.45, greatest(0.08, greatest(0.1, 0.45 / sqrt(n)))) AS alpha FROM s), r AS (SELECT key, list({v: v, a: alpha} ORDER BY n) AS l FROM a GROUP BY 1)
SELECT key, round(list_reduce(l, lambda x, y: {v: x.v + y.a * (y.v - x.v), a: 0.0::DOUBLE}, {v: l[1].v, a: 0.0::DOUBLE}).v, 6) AS ewma FROM r""")
def e24_ewma(spark, sf, base=0.1):
    s = events(spark, sf).where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("ts").alias("time"), F.col("value").alias("v"))
    alpha = lambda n: F.least(F.lit(0.45), F.greatest(F.lit(0.08), F.greatest(F.lit(base), 0.45 / F.sqrt(n))))
    return op.ewma(s, "key", "time", "v", alpha).select("key", F.round("ewma", 6).alias("ewma"))


@query(f"WITH {SERIES}, f AS (SELECT *, min(CASE WHEN v > 30 THEN epoch_us(time) END) OVER (PARTITION BY key) AS first FROM series) SELECT key, time FROM f WHERE epoch_us(time) BETWEEN first AND first + 172800000000")
def e44_trace_horizon(spark, sf):
    first = F.min(F.when(F.col("v") > 30, micros("time"))).over(Window.partitionBy("key"))
    return series(spark, sf).withColumn("f", first).where(micros("time").between(F.col("f"), F.col("f") + 2 * DAY)).select("key", "time")


@query("""SELECT user_id AS key, count(*) AS n, min(ts) AS first, max(ts) AS last, count_if(d <= 0) AS faults FROM (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) GROUP BY 1""")
def e41_strictly_increasing(spark, sf):
    e = events(spark, sf).withColumn("d", micros("ts") - F.lag(micros("ts")).over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("d") <= 0).alias("faults"))
