"""Sources and sinks: the given tables are written in the raw formats and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import HOUR, micros
from ..operators import clean as co
from ..registry import query
from ..sources import files as src
from ..sources.bindings import MEDIA, TYPES, WIDE15, events, media, table, wide15
from ..sources.listing import listing
from ..sources.scratch import folder, lines
from ..streaming.store import Store
from ..streaming.streams import source

R = lambda c, n=6: F.round(c, n)


def _text(c):
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("NAN"))


def _header(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


@query("SELECT date_trunc('second', ts) AS time, CASE WHEN value <= 50 THEN value END AS v FROM events")
def s1_logger_table(spark, sf):
    e = events(spark, sf).select(F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), _text(F.when(F.col("value") <= 50, F.col("value")))).alias("value"))
    path = lines(_header(spark, "TOA5,station", "TIMESTAMP,v", "TS,W", ",Avg").union(e), "logger")
    return src.logger_table(spark, path, ["v"])


@query("SELECT event_id, date_trunc('milliseconds', ts) AS time FROM events")
def s2_millisecond_repair(spark, sf):
    ms = F.when(micros("ts") % 1_000_000 >= 1000, F.floor(micros("ts") % 1_000_000 / 1000).cast("int"))
    e = events(spark, sf).select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("time"), ms.alias("ms"))
    return src.add_milliseconds(e, "time", "ms")


@query("SELECT date_trunc('second', ts) AS time, value AS load_W, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS \"on\" FROM events")
def s3_wide_csv(spark, sf):
    e = events(spark, sf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("value").alias("load (W)"), F.when(F.col("user_id") % 2 == 0, "True").otherwise("false").alias("on"), F.col("value").alias("wind_speed"), F.lit("n/a").alias("none"))
    e.write.csv(path := folder(spark, "wide"), header=True)
    return src.wide_csv(spark, path, "time")


@query("SELECT date_trunc('second', ts) AS time, value AS t FROM events")
def s4_local_times(spark, sf):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Nuuk")
    e = events(spark, sf).select(F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("value").alias("t"))
    e.write.csv(path := folder(spark, "met"), header=True)
    return src.local_csv(spark, path, ["t"], "America/Nuuk")


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 0")
def s5_json_lines(spark, sf):
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    e = events(spark, sf).select(F.when(F.col("event_id") % 20 == 0, "").when(F.col("event_id") % 10 == 0, F.concat(F.lit("{bad "), F.col("event_type"))).otherwise(good).alias("value"))
    return src.json_lines(spark, lines(e, "jsonl"), "event_id long, event_type string, value double")


@query("SELECT 'tier' AS kind, count(*) AS n, max(user_id % 5) AS top FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT 'malformed', count(*), NULL FROM events WHERE event_id % 7 = 0 AND event_id % 2 = 1")
def s6_regex_log(spark, sf):
    good = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(": Tier change "), (F.col("user_id") % 3).cast("string"), F.lit(" "), (F.col("user_id") % 5).cast("string"))
    e = events(spark, sf).select(F.when(F.col("event_id") % 14 == 0, "  ").when(F.col("event_id") % 7 == 0, "Tier lost").otherwise(good).alias("value"))
    rows, bad = src.tier_log(spark, lines(e, "tiers"))
    return rows.agg(F.lit("tier").alias("kind"), F.count(F.lit(1)).alias("n"), F.max("after").cast("long").alias("top")).unionByName(bad.agg(F.lit("malformed").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("top")))


@query("WITH l AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS time, user_id % 4 AS outlet, arg_max(value, event_id) AS w FROM events GROUP BY 1, 2) SELECT time, " + ", ".join(f"max(w) FILTER (outlet = {i}) AS outlet{i}_watts" for i in range(4)) + " FROM l GROUP BY 1")
def s7_outlets_wide(spark, sf):
    from ..functions.times import bucket

    long = events(spark, sf).select(bucket("ts", 60).alias("time"), (F.col("user_id") % 4).alias("outlet"), F.col("value").alias("watts"), F.col("event_id").alias("seq"))
    return src.outlets_wide(long, range(4))


@query("SELECT outlet, arg_min(name, (-n, name)) AS name FROM (SELECT user_id % 4 AS outlet, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def s7_outlet_names(spark, sf):
    return src.outlet_names(events(spark, sf).select((F.col("user_id") % 4).alias("outlet"), F.col("event_type").alias("name")))


@query("SELECT DISTINCT event_type || '_' || strftime(ts, '%Y%m%d') || '_0000.nc' AS path, date_trunc('day', ts) AS time, event_type <> 'view' AS readable FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'signup'")
def s8_dated_files(spark, sf):
    """A file a kind and day is written and listed: those with a date in their name from a day on, and whether they begin with the kind's signature."""
    day = F.when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit("_0000")))
    name = F.concat("event_type", day, F.lit(".nc"))
    e, at = events(spark, sf).select(name.alias("name"), F.when(F.col("event_type") == "view", "?").otherwise("CDF").alias("value")), folder(spark, "dated")
    e.repartition("name").write.partitionBy("name").text(at)
    files = listing(spark, at, "*.txt", head=3).select(F.regexp_extract("path", "name=([^/]+)", 1).alias("path"), (F.col("head") == F.encode(F.lit("CDF"), "utf-8")).alias("readable"))
    return src.dated_files(files, "2024-01-15 00:00:00").select("path", "time", "readable")


@query("WITH f AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'day/' ELSE '' END || 'f' || (event_id // 2) AS path, 'f' || (event_id // 2) AS name, event_id % 3 = 0 AS nested FROM events) SELECT path, name, nested FROM f QUALIFY nested OR NOT max(nested) OVER (PARTITION BY name)")
def s9_prefer_nested(spark, sf):
    path = F.concat(F.when(F.col("event_id") % 3 == 0, "day/").otherwise(""), F.lit("f"), F.expr("cast(event_id div 2 as string)"))
    return src.prefer_nested(events(spark, sf).select(path.alias("path")))


@query("SELECT url AS path, CASE WHEN coalesce(length(html), 0) = 0 THEN 'empty' WHEN substr(html, 1, 8) <> '<!DOCTYP' THEN 'unknown signature' END AS reason FROM pages")
def s10_readability_gate(spark, sf):
    f = table(spark, sf, "pages").select(F.col("url").alias("path"), F.octet_length("html").alias("length"), F.substring(F.encode("html", "utf-8"), 1, 8).alias("head"))
    return src.readable(f, ["<!DOCTYP"]).select("path", "reason")


@query("""WITH g AS (SELECT l_orderkey, list(CASE WHEN l_quantity > 45 THEN -999 ELSE l_quantity END ORDER BY l_linenumber, CASE WHEN l_quantity > 45 THEN -999 ELSE l_quantity END) AS a, list(CASE WHEN l_tax > 0.07 THEN -999 ELSE l_extendedprice END ORDER BY l_linenumber, CASE WHEN l_tax > 0.07 THEN -999 ELSE l_extendedprice END) AS b FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, unnest(a || b) AS raw, generate_subscripts(a || b, 1) - 1 AS gate FROM g) SELECT l_orderkey, CAST(gate AS INT) AS gate, gate * 10.0::DOUBLE AS range_m, round(CASE WHEN raw > 0 THEN 10 * log10(raw) END, 6) AS db FROM x""")
def s11_profile_assembly(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    arr = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", v.alias("v")))), lambda x: x["v"])
    g = l.groupBy("l_orderkey").agg(arr(F.when(F.col("l_quantity") > 45, -999.0).otherwise(F.col("l_quantity"))).alias("a"), arr(F.when(F.col("l_tax") > 0.07, -999.0).otherwise(F.col("l_extendedprice"))).alias("b"))
    return src.assemble_profile(g, "a", "b").withColumn("db", R("db"))


@query("""WITH g AS (SELECT s_suppkey AS cell, (s_suppkey % 18) * 5.0::DOUBLE AS lat, (s_suppkey // 18 % 36) * 10.0::DOUBLE AS lon FROM supplier), n AS (SELECT arg_min(lat, (abs(lat - 62.6), lat)) AS a, arg_min(lon, (abs(lon - 1.5), lon)) AS o FROM g) SELECT cell FROM g, n WHERE lat = a AND lon = o""")
def s12_nearest_cell(spark, sf):
    g = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), ((F.col("s_suppkey") % 18) * 5.0).alias("lat"), (F.expr("s_suppkey div 18 % 36") * 10.0).alias("lon"))
    return src.nearest_cell(g, 62.6, -358.5).select("cell")


@query("""WITH r AS (SELECT time_bucket(INTERVAL 6 hour, ts) AS cycle, user_id % 20 AS member, event_id % 8 AS step, event_id, value FROM events) SELECT cycle, member, step, cycle + to_hours(CAST(3 * step AS INT)) AS valid_time, value FROM r QUALIFY row_number() OVER (PARTITION BY cycle, member, step ORDER BY event_id DESC) = 1""")
def s13_member_steps(spark, sf):
    r = events(spark, sf).select(F.window("ts", "6 hours")["start"].alias("cycle"), (F.col("user_id") % 20).alias("member"), (F.col("event_id") % 8).alias("step"), "event_id", "value")
    last = co.first_per_key(r, ["cycle", "member", "step"], [F.desc("event_id")])
    return last.select("cycle", "member", "step", (F.col("cycle") + F.make_dt_interval(hours=(3 * F.col("step")).cast("int"))).alias("valid_time"), "value")


@query(f"WITH {MEDIA} SELECT path, time, size FROM media WHERE media_type = 'view' AND kind = 'image' AND day = DATE '2024-01-12'")
def s14_media_scan(spark, sf):
    """The catalog is written by day; type, kind and time are filters of the scan, the day prunes folders."""
    m = media(spark, sf)
    m.write.partitionBy("day").parquet(path := folder(spark, "media"))
    return spark.read.schema(m.schema).parquet(path).where("day = DATE '2024-01-12' AND media_type = 'view' AND kind = 'image'").select("path", "time", "size")


@query("SELECT date_trunc('second', ts) AS time, CASE WHEN value > 20 THEN 'on' ELSE 'off' END AS action, event_type AS kit FROM events WHERE event_type IN ('signup', 'error') AND event_id % 5 <> 0")
def s15_annotations(spark, sf):
    e = events(spark, sf).select(F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time_utc"), F.when(F.col("value") > 20, "ON").otherwise("off").alias("action"), F.col("event_type").alias("kit"), F.lit("").alias("note"))
    e.write.csv(path := folder(spark, "notes"), header=True)
    return src.annotations(spark, path, ["signup", "error"]).drop("note")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT ts, value FROM events WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT ts, value * 0 FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20') GROUP BY 1")
def s16_columnar_sink(spark, sf):
    """Create, append, and rebuild of single days: only the days that are written again are replaced."""
    e = events(spark, sf).select("ts", "value", F.to_date("ts").alias("day"))
    path, cut = folder(spark, "sink"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    e.where(F.col("ts") < cut).write.partitionBy("day").parquet(path)
    e.where("day = DATE '2024-01-20'").write.partitionBy("day").mode("append").parquet(path)
    e.where("day = DATE '2024-01-20'").withColumn("value", F.col("value") * 0).write.option("partitionOverwriteMode", "dynamic").partitionBy("day").mode("overwrite").parquet(path)
    return spark.read.schema(e.schema).parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), R(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, count(*) AS n, 2 AS reports FROM events GROUP BY 1")
def s17_report_sink(spark, sf):
    """The latest report is replaced, the history grows."""
    r = events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    latest, history = folder(spark, "latest"), folder(spark, "history")
    for _ in range(2):
        r.write.mode("overwrite").json(latest)
        r.write.mode("append").json(history)
    h = spark.read.schema(r.schema).json(history).groupBy("event_type").agg(F.count(F.lit(1)).cast("int").alias("reports"))
    return spark.read.schema(r.schema).json(latest).join(h, "event_type")


@query(f"WITH {WIDE15} SELECT time, round(click, 6) AS click, round(signup, 6) AS signup FROM wide15 WHERE click IS NOT NULL OR signup IS NOT NULL")
def s18_section_product(spark, sf):
    section = [t for t in TYPES if t in ("click", "signup")]
    return wide15(spark, sf).select("time", *[R(c).alias(c) for c in section]).na.drop(how="all", subset=section)


@query(f"""WITH {MEDIA}, f AS (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY path) AS rn FROM media) SELECT media_type, count(*) AS n, round(sum(size), 4) AS bytes, CAST(sum(CAST(('0x' || substr(sha256(path || '|' || event_id), 1, 8)) AS BIGINT)) AS BIGINT) AS digest, string_agg(path, ',' ORDER BY path) FILTER (rn <= 5) AS listed FROM f GROUP BY 1""")
def s19_manifest(spark, sf):
    m = media(spark, sf)
    out = src.manifest(m.select("media_type", "path", F.col("event_id").alias("size")), "media_type", 5).drop("bytes")
    return out.join(m.groupBy("media_type").agg(R(F.sum("size"), 4).alias("bytes")), "media_type")


@query("SELECT event_type AS camera, date_trunc('minute', ts) AS time, event_type || '_' || strftime(ts, '%Y%m%d_%H%M') || '.jpg' AS name FROM events WHERE event_id % 6 <> 0")
def s20_camera_index(spark, sf):
    own = F.concat(F.when(F.col("event_id") % 6 == 0, F.lit("other")).otherwise(F.col("event_type")), F.lit("/"), F.date_format("ts", "yyyyMMdd"), F.lit("/"), F.col("event_type"), F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmm"), F.lit(".jpg"))
    return src.camera_index(events(spark, sf).select(own.alias("path")))


@query("SELECT event_id, value, CASE WHEN event_id % 2 = 1 THEN event_type END AS event_type FROM events")
def t3_schema_policy(spark, sf):
    """A store of two columns grows by the one that is allowed when a second stream has it; that stream's other columns are dropped."""
    stream = source(spark, f"{sf}/events.parque[t]", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    at = folder(spark, "policy")
    store = Store(spark, f"{at}/store", ["event_id"], "event_id", policy="expand", allowed=["event_type"])
    store.follow(stream.where("event_id % 2 = 0").select("event_id", "value"), f"{at}/even", "even")
    return store.follow(stream.where("event_id % 2 = 1").select("event_id", "value", "event_type", "props"), f"{at}/odd", "odd")


@query("SELECT max(epoch_us(ts)) < epoch_us(TIMESTAMP '2024-01-31 06:00:00') - 3600000000 AS stale FROM events")
def t8_freshness_gate(spark, sf):
    now = F.lit("2024-01-31 06:00:00").cast("timestamp_ntz")
    return events(spark, sf).agg((micros(F.max("ts")) < micros(now) - HOUR).alias("stale"))
