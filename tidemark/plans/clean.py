"""Filters, projections and de-duplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clean as op
from ..operators import series as so
from ..registry import query
from ..sources.bindings import SERIES, WIDE15, events, series, table, wide15

NOW = "2024-01-20 00:00:00"


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def f1_numeric_coercion(spark, sf):
    e = events(spark, sf)
    rows = e.select("event_id", op.to_number(F.get_json_object("props", "$.k")).alias("k"), op.to_number(F.col("event_type")).alias("none"))
    return op.drop_empty_columns(rows, ["event_id"])


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def f2_time_floor(spark, sf):
    return op.since(events(spark, sf), "ts", ["2024-01-05T00:00:00Z", "2024-01-10"]).select("event_id", "ts")


@query("SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
def f3_window_slice(spark, sf):
    return op.window_slice(events(spark, sf), "ts", "2024-01-08 00:00:00", "2024-01-09 12:00:00").select("event_id", "value")


@query(f"SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '{NOW}' + INTERVAL 2 day AND event_id % 10 <> 0")
def f4_future_guard(spark, sf):
    rows = events(spark, sf).withColumn("ts", F.when(F.col("event_id") % 10 == 0, F.col("ts") + F.make_dt_interval(F.lit(3650))).otherwise(F.col("ts")))
    return op.drop_bogus_future(rows.select("event_id", "ts"), "ts", NOW)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber BETWEEN 2 AND least(9, 4)")
def f5_range_slice(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_linenumber").between(2, min(9, 4))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT event_id, event_type, round(CASE WHEN value BETWEEN low AND high THEN value * scale END, 6) AS value FROM events LEFT JOIN
(VALUES ('click', 0.0, 40.0, 2.0), ('error', 5.0, 60.0, 0.5), ('view', 1.0, 1e9, 1.0), ('signup', -1e9, 1e9, 1.0), ('purchase', -1e9, 1e9, 1.0)) r(event_type, low, high, scale) USING (event_type)""")
def f6_valid_range_scale(spark, sf):
    rules = spark.createDataFrame([("click", 0.0, 40.0, 2.0), ("error", 5.0, 60.0, 0.5), ("view", 1.0, None, 1.0)], "event_type string, low double, high double, scale double")
    rows = events(spark, sf).select("event_id", "event_type", "value")
    return op.apply_rules(rows, "event_type", "value", F.broadcast(rules)).withColumn("value", F.round("value", 6))


@query("""SELECT user_id, event_type, count(v) AS n FROM (SELECT user_id, event_type, CASE WHEN user_id % 5 = 0 THEN 0.0 WHEN user_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
GROUP BY ALL HAVING count(v) > 0 AND max(abs(v)) > 1e-8""")
def f7_signal_test(spark, sf):
    v = F.when(F.col("user_id") % 5 == 0, 0.0).when(F.col("user_id") % 7 != 0, F.col("value"))
    g = events(spark, sf).withColumn("v", v).groupBy("user_id", "event_type").agg(F.count("v").alias("n"), F.max(F.abs("v")).alias("m"))
    return g.where("n > 0 AND m > 1e-8").select("user_id", "event_type", "n")


@query(f"WITH {WIDE15} SELECT time, round(CASE WHEN click / view BETWEEN 0 AND 1 AND view >= pow(10, -6.5) THEN click / view END, 6) AS ratio, round(CASE WHEN error > 0 THEN log10(error) END, 6) AS log_error FROM wide15")
def f8_cross_mask_log(spark, sf):
    w = wide15(spark, sf)
    ratio = F.try_divide("click", "view")
    return w.select("time", F.round(F.when(ratio.between(0, 1) & (F.col("view") >= 10**-6.5), ratio), 6).alias("ratio"), F.round(F.when(F.col("error") > 0, F.log10("error")), 6).alias("log_error"))


@query("SELECT event_type AS name, count(value) AS n, regexp_matches(event_type, 'error|sign') AS status FROM events GROUP BY event_type HAVING count(value) > 0")
def f9_variable_discovery(spark, sf):
    g = events(spark, sf).groupBy(F.col("event_type").alias("name")).agg(F.count("value").alias("n")).where("n > 0")
    return g.withColumn("status", F.col("name").rlike("error|sign"))


@query(f"""WITH {WIDE15} SELECT time FROM wide15 WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'
OR (signup IS NOT NULL AND time > TIMESTAMP '2024-01-07' AND time <= TIMESTAMP '2024-01-07' + INTERVAL 96 hour)""")
def f10_display_crop(spark, sf):
    end = F.lit("2024-01-07 00:00:00").cast("timestamp_ntz")
    inside = F.col("time").between(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), end)
    return wide15(spark, sf).where(inside | (F.col("signup").isNotNull() & (F.col("time") > end) & (F.col("time") <= end + F.make_dt_interval(hours=F.lit(96))))).select("time")


@query("SELECT o_orderpriority AS caveat, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def f11_faceted_counts(spark, sf, status="O", priority="all"):
    rows = table(spark, sf, "orders").where((F.lit(status) == "all") | (F.col("o_orderstatus") == status)).where((F.lit(priority) == "all") | (F.col("o_orderpriority") == priority))
    return rows.groupBy(F.col("o_orderpriority").alias("caveat")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 day AND ts <= TIMESTAMP '{NOW}' ORDER BY ts DESC, event_id DESC LIMIT 2000")
def f12_trailing_newest(spark, sf):
    now = F.lit(NOW).cast("timestamp_ntz")
    return events(spark, sf).where((F.col("ts") > now - F.make_dt_interval(F.lit(7))) & (F.col("ts") <= now)).select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(2000)


@query(f"WITH {WIDE15} SELECT time, click FROM wide15 WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL AND view IS NOT NULL")
def f13_confirmed_rows(spark, sf):
    return wide15(spark, sf).dropna(how="any").select("time", "click")


@query("""WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, count(CASE WHEN l_linenumber > 3 THEN l_quantity END) AS n, sum(CASE WHEN l_linenumber > 3 THEN l_quantity END) AS q FROM lineitem GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM d WHERE n > 0) SELECT day, n, q FROM k WHERE (i - 1) % 3 = 0""")
def f14_profile_filter_stride(spark, sf):
    v = F.when(F.col("l_linenumber") > 3, F.col("l_quantity"))
    days = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(v).alias("n"), F.sum(v).alias("q")).where("n > 0")
    return days.withColumn("i", F.row_number().over(Window.orderBy("day"))).where("(i - 1) % 3 = 0").drop("i")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') >= 15) GROUP BY 1")
def f15_exclude_paused(spark, sf):
    e = events(spark, sf)
    paused = e.where("event_type = 'error'").groupBy("user_id").count().where("count >= 15").select("user_id")
    return e.join(paused, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WIDE15} SELECT max(time) AS latest, count(*) AS n FROM wide15 WHERE coalesce(click, error, view) IS NOT NULL AND time <= TIMESTAMP '{NOW}'")
def f16_observed_rows(spark, sf):
    rows = wide15(spark, sf).where(F.coalesce("click", "error", "view").isNotNull() & (F.col("time") <= F.lit(NOW).cast("timestamp_ntz")))
    return rows.agg(F.max("time").alias("latest"), F.count(F.lit(1)).alias("n"))


_TWICE = "d AS (SELECT user_id AS key, date_trunc('minute', ts) AS time, event_id AS seq, value AS v FROM events UNION ALL SELECT user_id, date_trunc('minute', ts), event_id + 1000000000, value + 1 FROM events WHERE event_id % 4 = 0)"


def _twice(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time"), F.col("event_id").alias("seq"), F.col("value").alias("v"))
    return e.union(e.where("seq % 4 = 0").select("key", "time", F.col("seq") + 1000000000, F.col("v") + 1))


@query(f"WITH {_TWICE} SELECT key, time, seq, v FROM d QUALIFY row_number() OVER (PARTITION BY key, time ORDER BY seq) = 1")
def e1_dedupe_first(spark, sf):
    return op.first_per_key(_twice(spark, sf), ["key", "time"], [F.col("seq")])


@query(f"WITH {_TWICE} SELECT key, time, seq, v FROM d QUALIFY row_number() OVER (PARTITION BY key, time ORDER BY seq DESC) = 1")
def e1_dedupe_last(spark, sf):
    return op.first_per_key(_twice(spark, sf), ["key", "time"], [F.desc("seq")])


@query(f"WITH {SERIES} SELECT key, time, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY key ORDER BY time) AS interval_us FROM series")
def e2_sample_interval(spark, sf):
    from ..functions.times import micros

    us = micros("time")
    return series(spark, sf).select("key", "time", (us - F.lag(us).over(Window.partitionBy("key").orderBy("time"))).alias("interval_us"))


@query(f"""WITH {_TWICE}, b AS (SELECT key, time, count(*) AS n FROM d GROUP BY 1, 2),
s AS (SELECT *, greatest(1000, least(1000000, floor(coalesce(epoch_us(lead(time) OVER w) - epoch_us(time), epoch_us(time) - epoch_us(lag(time) OVER w), 1000000) / n))) AS step FROM b WINDOW w AS (PARTITION BY key ORDER BY time))
SELECT d.key, seq, CAST(epoch_us(d.time) + (row_number() OVER (PARTITION BY d.key, d.time ORDER BY seq) - 1) * step AS BIGINT) AS time_us FROM d JOIN s ON d.key = s.key AND d.time = s.time""")
def e3_spread_duplicates(spark, sf):
    return op.spread_duplicates(_twice(spark, sf), "key", "time", "seq").select("key", "seq", F.col("time_us").cast("long"))


@query("SELECT event_id, event_type, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 25")
def k1_slowest_rows(spark, sf):
    return events(spark, sf).where("value IS NOT NULL").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("SELECT * FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) ORDER BY ts")
def k2_tail_ascending(spark, sf):
    return events(spark, sf).select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).orderBy("ts")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 10 OR i = 0 OR ((i * 9 + n - 2) // (n - 1)) * (n - 1) // 9 = i""")
def k3_even_pick(spark, sf, k=10):
    """Rows at the floors of k even steps from first to last, per series: i is picked if some j has floor(j (n-1) / (k-1)) = i."""
    return so.even_pick(events(spark, sf), "user_id", "ts", k).select("user_id", "event_id")


@query("SELECT event_type, arg_max(user_id, (h, -s, -user_id)) AS best FROM (SELECT event_type, user_id, count(*) AS h, count(*) FILTER (value > 50) AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def k4_best_candidate(spark, sf):
    c = events(spark, sf).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("h"), F.count_if(F.col("value") > 50).alias("s"))
    return c.groupBy("event_type").agg(F.max_by("user_id", F.struct("h", -F.col("s"), -F.col("user_id"))).alias("best"))


@query("SELECT c_custkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY n_regionkey DESC, c_acctbal DESC, c_custkey) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey")
def k5_panel_order(spark, sf):
    """Panels of a page in their order: a page per nation, a panel per customer."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    w = Window.partitionBy("n_name").orderBy(F.desc("n_regionkey"), F.desc("c_acctbal"), "c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).withColumn("place", F.row_number().over(w)).select("c_custkey", "n_name", "place")


@query("SELECT event_id AS id, value AS a, NULL::DOUBLE AS b FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, value FROM events WHERE event_type = 'view'")
def u1_union_by_name(spark, sf):
    e = events(spark, sf)
    return e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("value").alias("a")).unionByName(e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("value").alias("b")), allowMissingColumns=True)


@query("SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events ORDER BY ALL")
def u2_distinct_days(spark, sf):
    return events(spark, sf).select("event_type", F.to_date("ts").alias("day")).distinct().orderBy("event_type", "day")


@query("SELECT day FROM (SELECT CAST(ts AS DATE) AS day FROM events UNION SELECT CAST(o_orderdate AS DATE) FROM orders) ORDER BY day DESC LIMIT 60")
def u3_newest_days(spark, sf):
    days = events(spark, sf).select(F.to_date("ts").alias("day")).union(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")))
    return days.distinct().orderBy(F.desc("day")).limit(60)


@query("""WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 90)
SELECT user_id, event_type, 'extra' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, event_type, 'missing' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u4_set_difference(spark, sf):
    """Which columns a table of its own per user has beside, or lacks against, its store; a column is a kind of event."""
    e = events(spark, sf)
    own, store = e.where("value > 60"), e.where(F.get_json_object("props", "$.k").cast("double") > 90)
    return op.schema_difference(own.select("user_id", "event_type"), store.select("user_id", "event_type"))


@query("SELECT time_bucket(INTERVAL 15 minute, ts) AS time FROM events WHERE event_type = 'click' INTERSECT SELECT time_bucket(INTERVAL 15 minute, ts) FROM events WHERE event_type = 'error'")
def u5_shared_times(spark, sf):
    from ..functions.times import bucket

    e = events(spark, sf)
    at = lambda t: e.where(F.col("event_type") == t).select(bucket("ts", 15).alias("time"))
    return at("click").intersect(at("error"))
