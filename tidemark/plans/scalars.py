"""Scalar functions over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as fx
from ..functions.times import HOUR, micros
from ..registry import query
from ..sources.bindings import WIDE15, events, table, wide15

R = lambda c, n=6: F.round(c, n)


@query("""WITH h AS (SELECT event_id, value / 4 AS t, CAST(user_id % 110 AS DOUBLE) AS rh FROM events), g AS (SELECT *, CASE WHEN rh > 0 AND rh <= 100 THEN ln(rh / 100) + 17.625::DOUBLE * t / (243.04::DOUBLE + t) END AS g FROM h)
SELECT event_id, round(243.04::DOUBLE * g / (17.625::DOUBLE - g), 6) AS dew_point, round(t - 243.04::DOUBLE * g / (17.625::DOUBLE - g), 6) + 0 AS margin FROM g""")
def x1_dew_point(spark, sf):
    e = events(spark, sf).select("event_id", (F.col("value") / 4).alias("t"), (F.col("user_id") % 110).cast("double").alias("rh"))
    d = fx.dew_point(F.col("t"), F.when(F.col("rh") > 0, F.col("rh")))
    return e.select("event_id", R(d).alias("dew_point"), (R(F.col("t") - d) + 0.0).alias("margin"))


@query("WITH w AS (SELECT event_id, value - 20 AS u, CAST(user_id % 13 AS DOUBLE) - 6 AS v FROM events) SELECT event_id, round(sqrt(u * u + v * v), 6) AS speed, round(((270 - degrees(atan2(v, u))) % 360 + 360) % 360, 6) AS direction FROM w")
def x2_wind(spark, sf):
    speed, direction = fx.wind(F.col("value") - 20, (F.col("user_id") % 13).cast("double") - 6)
    return events(spark, sf).select("event_id", R(speed).alias("speed"), R(direction).alias("direction"))


@query("""WITH p AS (SELECT event_id, (user_id % 170) - 85.0::DOUBLE AS lat, (event_id % 360) - 180.0::DOUBLE AS lon FROM events), d AS (SELECT *, radians(72.6::DOUBLE - lat) AS a, radians(((-38.5::DOUBLE - lon + 180) % 360 + 360) % 360 - 180) AS b FROM p)
SELECT event_id, round(2 * 6371 * asin(sqrt(least(1, pow(sin(a / 2), 2) + cos(radians(lat)) * cos(radians(72.6::DOUBLE)) * pow(sin(b / 2), 2)))), 4) AS km FROM d""")
def x3_haversine(spark, sf):
    lat, lon = (F.col("user_id") % 170) - F.lit(85.0), (F.col("event_id") % 360) - F.lit(180.0)
    return events(spark, sf).select("event_id", R(fx.haversine_km(lat, lon, F.lit(72.6), F.lit(-38.5)), 4).alias("km"))


@query("SELECT event_id, round(CASE WHEN value > 0 THEN 10 * log10(value) END, 6) AS db, round(value + 250 - 273.15::DOUBLE, 6) AS celsius, round(event_id / 1048576.0::DOUBLE, 9) AS mb, abs(extract(minute FROM ts) - 30) AS offset_min FROM events")
def x4_unit_conversions(spark, sf):
    return events(spark, sf).select("event_id", R(fx.decibel(F.col("value"))).alias("db"), R(F.col("value") + 250 - F.lit(273.15)).alias("celsius"), R(F.col("event_id") / 1048576.0, 9).alias("mb"), F.abs(F.minute("ts") - 30).cast("long").alias("offset_min"))


_LEVELS = """x AS (SELECT event_id, nullif(value, 0) AS used, nullif(event_id % 5, 4) AS n, nullif(event_id % 60, 7) AS age, 45 + user_id % 10 AS volt, user_id % 101 AS soc, event_id % 60 - 5 AS temp, event_id % 7 - 2 AS margin, nullif(event_id % 4, 3) = 0 AS humid, value * 40 - 1000 AS watts,
CASE WHEN event_id % 3 = 0 THEN value END AS hours, value * 60 AS p95, event_id % 9 > 0 AS log_there, event_id % 500 AS log_age FROM events)"""


@query(f"""WITH {_LEVELS} SELECT event_id,
CASE WHEN used IS NULL THEN 'gray' WHEN used < 75 THEN 'green' WHEN used < 90 THEN 'amber' ELSE 'red' END AS used, CASE WHEN n IS NULL THEN 'gray' WHEN n <= 0 THEN 'green' WHEN n <= 1 THEN 'amber' ELSE 'red' END AS fails,
CASE WHEN n IS NULL THEN 'gray' WHEN n <= 0 THEN 'green' WHEN n < 3 THEN 'amber' ELSE 'red' END AS probes, CASE WHEN age IS NULL THEN 'gray' WHEN age <= 10 THEN 'green' WHEN age <= 30 THEN 'amber' ELSE 'red' END AS age,
CASE WHEN volt > 52 THEN 'green' WHEN volt >= 50 THEN 'amber' ELSE 'red' END AS voltage, CASE WHEN soc >= 50 THEN 'green' WHEN soc > 40 THEN 'amber' ELSE 'red' END AS soc,
CASE WHEN temp < 5 OR temp >= 45 THEN 'red' WHEN temp < 10 OR temp >= 40 THEN 'amber' ELSE 'green' END AS temperature, CASE WHEN humid = false OR margin IS NULL THEN 'gray' WHEN margin <= 0 THEN 'red' ELSE 'green' END AS dewpoint,
CASE WHEN watts >= -50 THEN 'green' WHEN coalesce(hours, soc / 100.0::DOUBLE * 26 / (abs(watts) / 1000)) >= 24 THEN 'green' WHEN coalesce(hours, soc / 100.0::DOUBLE * 26 / (abs(watts) / 1000)) >= 12 THEN 'amber' ELSE 'red' END AS depletion,
CASE WHEN p95 <= 1000 THEN 'green' WHEN p95 <= 3000 THEN 'amber' ELSE 'red' END AS latency, CASE WHEN NOT log_there THEN 'red' WHEN log_age <= 30 THEN 'green' WHEN log_age <= 360 THEN 'amber' ELSE 'red' END AS perf_log FROM x""")
def x5_level_thresholds(spark, sf):
    """The levels of every health card, with its thresholds as parameters of its function."""
    from ..operators import stats as op

    c, e = F.col, F.col("event_id")
    x = events(spark, sf).select(e, F.nullif("value", F.lit(0)).alias("used"), F.nullif(e % 5, F.lit(4)).alias("n"), F.nullif(e % 60, F.lit(7)).alias("age"), (45 + c("user_id") % 10).alias("volt"), (c("user_id") % 101).alias("soc"), (e % 60 - 5).alias("temp"), (e % 7 - 2).alias("margin"), (F.nullif(e % 4, F.lit(3)) == 0).alias("humid"), (c("value") * 40 - 1000).alias("watts"), F.when(e % 3 == 0, c("value")).alias("hours"), (c("value") * 60).alias("p95"), (e % 9 > 0).alias("log_there"), (e % 500).alias("log_age"))
    return x.select(
        e, op.level(c("used"), 75, 90).alias("used"), op.count_level(c("n")).alias("fails"), F.when(c("n") >= 3, "red").otherwise(op.count_level(c("n"), 2)).alias("probes"), op.age_level(c("age")).alias("age"),
        F.when(c("volt") > 52, "green").otherwise(op.below(c("volt"), 53, 50)).alias("voltage"), F.when(c("soc") <= 40, "red").otherwise(op.below(c("soc"), 50, 40)).alias("soc"),
        op.band_level(c("temp"), (5, 10), (45, 40)).alias("temperature"), op.margin_level(c("margin"), c("humid")).alias("dewpoint"), op.depletion_level(c("watts"), c("soc"), c("hours")).alias("depletion"),
        op.age_level(c("p95"), 1000, 3000).alias("latency"), F.when(~c("log_there"), "red").otherwise(op.age_level(c("log_age"), 30, 360)).alias("perf_log"),
    )


@query("SELECT event_id, CASE WHEN w > 5 THEN 'charging' WHEN w < -5 THEN 'discharging' ELSE 'idle' END AS state, round(24.0::DOUBLE * soc / 100, 6) AS kwh, round(CASE WHEN w < -5 THEN 24000.0::DOUBLE * soc / 100 / -w END, 6) AS hours_left FROM (SELECT event_id, value - 20 AS w, user_id % 101 AS soc FROM events)")
def x6_battery_state(spark, sf, capacity=24.0):
    w, soc = F.col("value") - 20, F.col("user_id") % 101
    return events(spark, sf).select("event_id", fx.charge_state(w, 5).alias("state"), R(capacity * soc / 100).alias("kwh"), R(F.when(w < -5, 1000 * capacity * soc / 100 / -w)).alias("hours_left"))


@query("SELECT event_id, round(100 * (least(greatest(w, 0), 800) * 0.95::DOUBLE - least(greatest(-w, 0), 600) / 0.9::DOUBLE) * 0.25::DOUBLE / (1000 * 24), 6) AS delta FROM (SELECT event_id, value * 30 - 700 AS w FROM events)")
def x7_soc_step(spark, sf):
    return events(spark, sf).select("event_id", R(fx.soc_step(F.col("value") * 30 - 700, F.lit(0.25), 24.0, 800.0, 600.0, 0.95, 0.9)).alias("delta"))


@query(f"WITH {WIDE15} SELECT time, round(CASE WHEN click IS NOT NULL AND view IS NOT NULL THEN greatest(click + coalesce(purchase, 0) - view, 0) ELSE error + signup END, 6) AS load FROM wide15")
def x8_power_balance(spark, sf):
    balance = F.greatest(F.col("click") + F.coalesce("purchase", F.lit(0.0)) - F.col("view"), F.lit(0.0))
    return wide15(spark, sf).select("time", R(F.when(F.col("click").isNotNull() & F.col("view").isNotNull(), balance).otherwise(F.col("error") + F.col("signup"))).alias("load"))


@query(f"""WITH {WIDE15}, m AS (SELECT time, (click IS NOT NULL)::INT + 2 * (error IS NOT NULL)::INT + 4 * (view IS NOT NULL)::INT AS code FROM wide15)
SELECT time, code, CASE WHEN code = 0 THEN 'idle' ELSE concat_ws('+', CASE WHEN code & 1 > 0 THEN 'click' END, CASE WHEN code & 2 > 0 THEN 'error' END, CASE WHEN code & 4 > 0 THEN 'view' END) END AS label FROM m""")
def x9_mode_code(spark, sf):
    names = ["click", "error", "view"]
    w = wide15(spark, sf).withColumn("code", fx.mode_code([F.col(n).isNotNull() for n in names]))
    return w.select("time", "code", fx.mode_label(F.col("code"), names).alias("label"))


@query(f"WITH {WIDE15} SELECT time, CASE WHEN click IS NULL AND error IS NULL THEN 'unknown' WHEN coalesce(click, 0) >= 20 THEN CASE WHEN view IS NOT NULL THEN 'active-confirmed' ELSE 'active' END ELSE 'idle' END AS mode, round(((click IS NOT NULL)::INT + (error IS NOT NULL)::INT + (view IS NOT NULL)::INT) / 3.0::DOUBLE, 6) AS confidence FROM wide15")
def x10_mode_class(spark, sf):
    seen = sum((F.col(c).isNotNull().cast("int") for c in ("click", "error", "view")), F.lit(0))
    active = F.when(F.col("view").isNotNull(), "active-confirmed").otherwise("active")
    mode = F.when(F.col("click").isNull() & F.col("error").isNull(), "unknown").when(F.coalesce("click", F.lit(0.0)) >= 20, active).otherwise("idle")
    return wide15(spark, sf).select("time", mode.alias("mode"), R(seen / 3.0).alias("confidence"))


@query(f"""WITH {WIDE15}, s AS (SELECT time, coalesce(click, error, view, 10) AS load, CASE WHEN click IS NOT NULL THEN 'meter' WHEN error IS NOT NULL THEN 'balance' WHEN view IS NOT NULL THEN 'learned' ELSE 'fallback' END AS source FROM wide15)
SELECT source, count(*) AS n, round(quantile_cont(load, 0.1), 6) AS p10, round(quantile_cont(load, 0.9), 6) AS p90 FROM s GROUP BY 1""")
def x11_load_cascade(spark, sf):
    src = F.when(F.col("click").isNotNull(), "meter").when(F.col("error").isNotNull(), "balance").when(F.col("view").isNotNull(), "learned").otherwise("fallback")
    s = wide15(spark, sf).select(F.coalesce("click", "error", "view", F.lit(10.0)).alias("load"), src.alias("source"))
    g = s.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.percentile("load", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return g.select("source", "n", R(F.col("q")[0]).alias("p10"), R(F.col("q")[1]).alias("p90"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.9) AS c FROM events GROUP BY 1), k AS (SELECT *, k, (k + 0.5::DOUBLE) / 20 AS r FROM q, (SELECT unnest(range(20)) AS k))
SELECT event_type, CAST(k AS INT) AS member, round(CASE WHEN r <= 0.1 THEN a WHEN r >= 0.9 THEN c WHEN r <= 0.5 THEN a + (r - 0.1::DOUBLE) / 0.4::DOUBLE * (b - a) ELSE b + (r - 0.5::DOUBLE) / 0.4::DOUBLE * (c - b) END, 8) AS level FROM k""")
def x12_member_level(spark, sf, members=20):
    q = events(spark, sf).groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    k = q.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    return k.select("event_type", "member", R(fx.quantile_at((F.col("member") + 0.5) / members, F.col("q")[0], F.col("q")[1], F.col("q")[2]), 8).alias("level"))


@query("""SELECT family, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p_type, '(?i)tablet|ipad') THEN 'tablet' WHEN regexp_matches(p_type, '(?i)brass|phone') THEN 'mobile' WHEN regexp_matches(p_type, '(?i)steel|copper') THEN 'desktop' ELSE 'other' END AS family FROM part) GROUP BY 1""")
def x13_client_family(spark, sf):
    t = F.col("p_type")
    fam = F.when(t.rlike("(?i)tablet|ipad"), "tablet").when(t.rlike("(?i)brass|phone"), "mobile").when(t.rlike("(?i)steel|copper"), "desktop").otherwise("other")
    return table(spark, sf, "part").groupBy(fam.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%_C' THEN 'degC' WHEN regexp_matches(lower(p_brand), '1[0-9]') THEN 'W' WHEN regexp_matches(lower(p_type), 'std|standard') THEN '%' ELSE '' END AS unit FROM part")
def x14_unit_inference(spark, sf):
    u = F.when(F.col("p_name").like("%_C"), "degC").when(F.lower("p_brand").rlike("1[0-9]"), "W").when(F.lower("p_type").rlike("std|standard"), "%").otherwise("")
    return table(spark, sf, "part").select("p_partkey", u.alias("unit"))


@query("""SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('minute', ts) AS named, TIMESTAMP '2024-01-01' + to_hours(CAST(event_id % 500 AS INT)) AS cf FROM events""")
def x15_time_parsing(spark, sf):
    """ISO text with a Z, a file name's stamp, and hours since an origin, each written and parsed."""
    e = events(spark, sf)
    iso, name = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.lit("cam1_"), F.date_format("ts", "yyyyMMdd_HHmm"), F.lit(".jpg"))
    cf = F.concat(F.lit("hours since 2024-01-01 00:00:00|"), (F.col("event_id") % 500).cast("string"))
    stamp = F.regexp_extract(name, r"_(\d{8}_\d{4})\.", 1)
    origin = F.try_to_timestamp(F.regexp_extract(cf, r"since ([^|]+)", 1)).cast("timestamp_ntz")
    return e.select("event_id", F.try_to_timestamp(F.regexp_replace(iso, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("iso"), F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmm")).cast("timestamp_ntz").alias("named"), (origin + F.make_dt_interval(hours=F.regexp_extract(cf, r"\|(\d+)$", 1).cast("int"))).alias("cf"))


@query("""SELECT event_id, time_bucket(INTERVAL 10 minute, ts) AS step, strftime(ts, '%Y%m%d') AS day, CAST(extract(hour FROM ts) AS INT) AS hour, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 60000000 AS age_min FROM events""")
def x16_time_tokens(spark, sf):
    from ..functions.times import bucket

    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return events(spark, sf).select("event_id", bucket("ts", 10).alias("step"), F.date_format("ts", "yyyyMMdd").alias("day"), F.hour("ts").alias("hour"), F.floor((micros(now) - micros("ts")) / 60_000_000).alias("age_min"))


@query("SELECT user_id, sha256(concat_ws('|', CAST(CAST(round(avg(value) / 2) AS BIGINT) * 2 AS VARCHAR), CAST(CAST(round(max(value) / 5) AS BIGINT) * 5 AS VARCHAR), CAST(count(*) AS VARCHAR))) AS signature FROM events GROUP BY 1")
def x17_signature(spark, sf):
    """Inputs rounded to steps, so that small changes keep the signature."""
    step = lambda c, s: (F.round(c / s).cast("long") * s).cast("string")
    return events(spark, sf).groupBy("user_id").agg(F.sha2(F.concat_ws("|", step(F.avg("value"), 2), step(F.max("value"), 5), F.count(F.lit(1)).cast("string")), 256).alias("signature"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.missing') AS DOUBLE), try_cast(json_extract_string(props, '$.k') AS DOUBLE), -1) AS metric, 'k = ' || coalesce(json_extract_string(props, '$.k'), '?') || ' ± ' || CAST(user_id AS VARCHAR) AS said FROM events")
def x18_json_lookup(spark, sf):
    at = lambda p: F.get_json_object("props", p)
    return events(spark, sf).select("event_id", F.coalesce(at("$.missing").try_cast("double"), at("$.k").try_cast("double"), F.lit(-1.0)).alias("metric"), F.concat(F.lit("k = "), F.coalesce(at("$.k"), F.lit("?")), F.lit(" ± "), F.col("user_id").cast("string")).alias("said"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'tier1' WHEN '2-HIGH' THEN 'tier1' WHEN '5-LOW' THEN 'tier3' ELSE 'tier2' END || '/' || o_orderstatus AS state_id FROM orders")
def x19_state_id(spark, sf):
    tier = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "tier1").when(F.col("o_orderpriority") == "5-LOW", "tier3").otherwise("tier2")
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("/", tier, "o_orderstatus").alias("state_id"))


@query("""WITH d AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE AS h FROM events GROUP BY 1) SELECT user_id, CASE WHEN h <= 2 THEN 1200 WHEN h <= 6 THEN 800 WHEN h <= 24 THEN 400 ELSE 300 END AS target, CASE WHEN h <= 24 THEN 1 ELSE 2 END AS stride FROM d""")
def x20_sampling_target(spark, sf):
    d = events(spark, sf).groupBy("user_id").agg(((micros(F.max("ts")) - micros(F.min("ts"))) / HOUR).alias("h"))
    h = F.col("h")
    return d.select("user_id", F.when(h <= 2, 1200).when(h <= 6, 800).when(h <= 24, 400).otherwise(300).alias("target"), F.when(h <= 24, 1).otherwise(2).alias("stride"))


@query(f"WITH {WIDE15} SELECT time, round(coalesce(click, 0) + coalesce(error, 0), 6) AS issues, round(greatest(coalesce(view, 0) - coalesce(error, 0), 0), 6) AS excess, 1 - (signup IS NOT NULL)::INT AS down FROM wide15")
def x21_issue_counters(spark, sf):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return wide15(spark, sf).select("time", R(z("click") + z("error")).alias("issues"), R(F.greatest(z("view") - z("error"), F.lit(0.0))).alias("excess"), (1 - F.col("signup").isNotNull().cast("int")).alias("down"))


@query("""WITH l AS (SELECT user_id, event_type, arg_max(value, ts) AS v, max(ts) AS ts FROM events GROUP BY 1, 2), a AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000.0::DOUBLE AS age FROM l)
SELECT user_id, event_type, CASE WHEN v IS NULL THEN 'gray' WHEN v >= 90 OR age >= 240 THEN 'red' WHEN v >= 50 OR age >= 72 THEN 'amber' ELSE 'green' END AS level FROM a""")
def x22_fresh_level(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    l = events(spark, sf).groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("v"), ((micros(now) - micros(F.max("ts"))) / HOUR).alias("age"))  # noqa: E741
    lv = F.when(F.col("v").isNull(), "gray").when((F.col("v") >= 90) | (F.col("age") >= 240), "red").when((F.col("v") >= 50) | (F.col("age") >= 72), "amber").otherwise("green")
    return l.select("user_id", "event_type", lv.alias("level"))
