"""Jobs composed of several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as fx
from ..functions.times import micros
from ..operators import clean as co
from ..operators import catalog, coverage, grids, perf
from ..registry import query
from ..sources.bindings import MEDIA, PERFLOG, TYPES, WIDE15, events, media, perflog, table, wide15
from ..sources.scratch import table as kept

R = lambda c, n=6: F.round(c, n)


@query(f"""WITH {WIDE15}, s AS (SELECT coalesce(a.time, b.time) AS time, coalesce(a.click, b.view) AS u, b.signup AS v FROM (SELECT time, click FROM wide15 WHERE click IS NOT NULL) a FULL JOIN (SELECT time, view, signup FROM wide15 WHERE view IS NOT NULL OR signup IS NOT NULL) b ON a.time = b.time)
SELECT time, round(u, 6) AS u, round(v, 6) AS v, round(sqrt(u * u + v * v), 6) AS speed, round(((270 - degrees(atan2(v, u))) % 360 + 360) % 360, 6) AS direction FROM s""")
def p2_meteorology_summary(spark, sf):
    """The slow station filled up from the fast one, with wind."""
    w = wide15(spark, sf)
    a = w.where("click IS NOT NULL").select("time", "click")
    b = w.where("view IS NOT NULL OR signup IS NOT NULL").select("time", "view", "signup")
    s = a.join(b, "time", "fullouter").select("time", F.coalesce("click", "view").alias("u"), F.col("signup").alias("v"))
    speed, direction = fx.wind(F.col("u"), F.col("v"))
    return s.select("time", R("u").alias("u"), R("v").alias("v"), R(speed).alias("speed"), R(direction).alias("direction"))


@query("""WITH g AS (SELECT CAST(l_shipdate AS DATE) AS time, l_partkey AS gate, avg(l_quantity) AS v FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND l_partkey BETWEEN 0 AND 2500 GROUP BY 1, 2),
s AS (SELECT g.* FROM g JOIN (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM g)) t ON g.time = t.time AND i % 2 = 0),
h AS (SELECT gate, row_number() OVER (ORDER BY gate) - 1 AS i, count(*) OVER () AS n, greatest(1, CAST(ceil(count(*) OVER () / 300.0) AS BIGINT)) AS k FROM (SELECT DISTINCT gate FROM s)),
t AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n, greatest(1, CAST(ceil(count(*) OVER () / 300.0) AS BIGINT)) AS k FROM (SELECT DISTINCT time FROM s)),
hc AS (SELECT gate, avg(gate) OVER (PARTITION BY i // k) AS c FROM h WHERE (i // k + 1) * k <= n), tc AS (SELECT time, CAST(sum(epoch_us(time)) OVER w // count(*) OVER w AS BIGINT) AS c FROM t WHERE (i // k + 1) * k <= n WINDOW w AS (PARTITION BY i // k)),
m AS (SELECT time, hc.c AS gate, avg(v) AS v FROM s JOIN hc USING (gate) GROUP BY 1, 2) SELECT make_timestamp(tc.c) AS time, gate, round(avg(v), 6) AS v FROM m JOIN tc ON m.time = tc.time GROUP BY 1, 2""")
def p3_window_view(spark, sf, start="1997-01-01 00:00:00", end="1998-12-31 00:00:00"):
    """Two years and 2,500 gates of a grid, thinned and coarsened in gates and time to what a view of that size needs."""
    g = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("time"), F.col("l_partkey").alias("gate")).agg(F.avg("l_quantity").alias("v"))
    return grids.window_view(g, "time", "gate", "v", start, end, 0.0, 2500.0).withColumn("v", R("v"))


_MEDIA_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH {MEDIA}, n AS (SELECT * FROM media WHERE event_id % 3 <> 0), u AS (SELECT *, 0 AS rev FROM media WHERE event_id % 3 = 0 UNION ALL SELECT *, 1 FROM n), h AS (SELECT *, CAST(hour(time) AS INT) AS hr, epoch_us(time) % 3600000000 AS us FROM u),
rep AS (SELECT media_type, day, hr, event_id FROM h QUALIFY row_number() OVER (PARTITION BY media_type, day, hr ORDER BY abs(us // 1000000 - 1800), us // 1000000, us) = 1), st AS (SELECT day, hr, count(DISTINCT media_type) AS k FROM h GROUP BY 1, 2)
SELECT 'day' AS section, media_type AS name, day, NULL::INT AS hour, count(*) AS n, count(DISTINCT hr) AS hours, max(time) AS frontier, arg_min(event_id, (CASE kind WHEN 'video' THEN 0 ELSE 1 END, -epoch_us(time))) AS record, NULL AS records FROM h GROUP BY 2, 3
UNION ALL SELECT 'hour', NULL, day, hr, NULL, NULL, NULL, NULL, concat_ws(',', {", ".join(f"coalesce(CAST(max(event_id) FILTER (media_type = '{t}') AS VARCHAR), '-')" for t in _MEDIA_TYPES)}) FROM rep GROUP BY day, hr
UNION ALL SELECT 'state', NULL, d.day, g.hr, CASE WHEN k = 5 THEN 2 WHEN k > 0 THEN 1 ELSE 0 END, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT day FROM st) d CROSS JOIN (SELECT CAST(unnest(range(24)) AS INT) AS hr) g LEFT JOIN st ON st.day = d.day AND st.hr = g.hr""")
def p10_media_catalog(spark, sf):
    """New or changed files join the catalog; its days with frontier and preferred record, each hour's representatives by kind, and each hour's presence."""
    m = media(spark, sf)
    known = m.where("event_id % 3 = 0")
    new = m.join(known.select("path", "size", "time"), ["path", "size", "time"], "left_anti")
    both = known.withColumn("rev", F.lit(0)).unionByName(new.withColumn("rev", F.lit(1)))
    cat = kept(co.first_per_key(both, ["path"], [F.desc("rev")]), "catalog")
    days = catalog.preferred(cat, "media_type", "time", "event_id", "kind").withColumnsRenamed({"media_type": "name", "preferred": "record"}).withColumn("section", F.lit("day"))
    wide = catalog.hourly_pivot(catalog.representative_hours(cat, "media_type", "time", "event_id"), "media_type", "event_id", _MEDIA_TYPES)
    hours_ = wide.select(F.lit("hour").alias("section"), "day", "hour", F.concat_ws(",", *[F.coalesce(F.col(t).cast("string"), F.lit("-")) for t in _MEDIA_TYPES]).alias("records"))
    states = catalog.presence(cat, "media_type", "time", _MEDIA_TYPES).select(F.lit("state").alias("section"), "day", "hour", F.col("state").cast("long").alias("n"))
    whole = days.unionByName(hours_, allowMissingColumns=True).unionByName(states, allowMissingColumns=True)
    return whole.select("section", "name", "day", "hour", "n", "hours", "frontier", "record", "records")


_LOG = f"""{PERFLOG}, lg AS (SELECT *, 'c' || (session % 3) AS control, ['', 'Googlebot/2.1', 'Mozilla (iPad)', 'Mozilla (iPhone; Mobile)', 'Mozilla (X11)'][event_id % 5 + 1] AS agent, CASE WHEN event_id % 4 > 0 THEN '/p' || (session % 13) END AS path FROM perflog)"""
_OF = lambda rows, keys, v: f"SELECT {keys} AS name, count({v}) AS n, round(avg({v}), 6) AS value, round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.95), 6) AS p95, max({v}) AS high FROM {rows} WHERE {v} IS NOT NULL GROUP BY 1"
_TOP = lambda rows, name, most: f"SELECT {name} AS name, count(*) AS n, NULL AS value, NULL AS p50, NULL AS p95, NULL AS high FROM {rows} GROUP BY 1" + (f" ORDER BY n DESC, name LIMIT {most}" if most else "")


@query(f"""WITH {_LOG}, ph AS (SELECT instrument, phase, v FROM (SELECT instrument, duration_ms AS phase_a, k AS phase_b FROM lg WHERE event = 'click') UNPIVOT (v FOR phase IN (phase_a, phase_b)))
SELECT 'timing' AS section, * FROM ({_OF("lg", "event || '/' || instrument", "duration_ms")}) UNION ALL SELECT 'phase', * FROM ({_OF("ph", "instrument || '/' || phase", "v")})
UNION ALL SELECT 'session', name, NULL, value, NULL, NULL, NULL FROM (SELECT unnest(['sessions', 'loaded', 'closed', 'heartbeats', 'max_k', 'max_duration_ms']) AS name, unnest([count(DISTINCT session), count_if(event = 'signup'), count_if(event = 'purchase'), count_if(event = 'error'), max(k), max(duration_ms)]::DOUBLE[]) AS value FROM lg)
UNION ALL SELECT 'change', * FROM ({_TOP("(SELECT * FROM lg WHERE event = 'view')", "instrument || '/' || control", 10)}) UNION ALL SELECT 'client', * FROM ({_TOP("(SELECT ['unknown', 'bot', 'tablet', 'mobile', 'desktop'][event_id % 5 + 1] AS f FROM lg WHERE event = 'signup')", "f", 0)})
UNION ALL SELECT 'path', * FROM ({_TOP("(SELECT path FROM lg WHERE event = 'signup' AND path IS NOT NULL)", "path", 10)}) UNION ALL SELECT 'coverage', * FROM ({_TOP("(SELECT instrument FROM lg WHERE event IN ('click', 'view'))", "CAST(instrument AS VARCHAR)", 0)})
UNION ALL SELECT 'slowest', CAST(event_id AS VARCHAR), NULL, round(duration_ms, 6), NULL, NULL, NULL FROM (SELECT * FROM lg WHERE duration_ms IS NOT NULL ORDER BY duration_ms DESC, event_id LIMIT 10)""")
def p13_performance_summary(spark, sf):
    agents = F.array(*[F.lit(x) for x in ("", "Googlebot/2.1", "Mozilla (iPad)", "Mozilla (iPhone; Mobile)", "Mozilla (X11)")])
    log = perflog(spark, sf).withColumns({"control": F.concat(F.lit("c"), F.col("session") % 3), "agent": F.get(agents, (F.col("event_id") % 5).cast("int")), "path": F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("/p"), F.col("session") % 13)), "phase_a": F.col("duration_ms"), "phase_b": F.col("k")})
    s = perf.performance_summary(log, ["phase_a", "phase_b"], ["k", "duration_ms"], "click", "signup", "purchase", "error", "view", ["click", "view"])
    return s.select("section", "name", "n", *[R(c).alias(c) for c in ("value", "p50", "p95")], "high")


@query("""WITH d AS (SELECT event_type AS name, CAST(ts AS DATE) AS day, CAST(bit_or(1::BIGINT << CAST(hour(ts) AS INT)) AS BIGINT) AS bits FROM events WHERE value > 15 GROUP BY 1, 2), w AS (SELECT TIMESTAMP '2024-01-05 06:30:00' AS a, TIMESTAMP '2024-01-20 18:00:00' AS z),
h AS (SELECT event_type AS name, count(DISTINCT date_trunc('hour', ts)) AS seen FROM events, w WHERE value > 15 AND date_trunc('hour', ts) BETWEEN date_trunc('hour', a) AND date_trunc('hour', z) GROUP BY 1), x AS (SELECT date_diff('hour', date_trunc('hour', a), date_trunc('hour', z)) + 1 AS expected FROM w),
g AS (SELECT event_type AS name, least(63, (epoch_us(ts) - epoch_us(a)) * 64 // (epoch_us(z) - epoch_us(a))) AS s FROM events, w WHERE value > 15 AND ts BETWEEN a AND z),
k AS (SELECT day, hh, count(DISTINCT name) AS n FROM (SELECT DISTINCT day FROM d) JOIN (SELECT unnest(range(24)) AS hh) ON true LEFT JOIN (SELECT day AS dy, name, bits FROM d) b ON b.dy = day AND (bits >> CAST(hh AS INT)) & 1 = 1 GROUP BY 1, 2)
SELECT 'bits' AS section, name || ' ' || day AS name, bits, CAST(bit_count(bits) AS BIGINT) AS seen, 24 - bit_count(bits) AS missing FROM d UNION ALL SELECT 'hours', name, NULL, seen, expected - seen FROM h, x
UNION ALL SELECT 'segments', name, CAST(bit_or(CASE WHEN s < 32 THEN 1::BIGINT << CAST(s AS INT) ELSE 0 END) AS BIGINT), count(DISTINCT s), 64 - count(DISTINCT s) FROM g GROUP BY 2
UNION ALL SELECT 'state', day || ' ' || lpad(CAST(hh AS VARCHAR), 2, '0'), CASE WHEN n = 5 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END, NULL, NULL FROM k""")
def p14_availability_strip(spark, sf, start="2024-01-05 06:30:00", end="2024-01-20 18:00:00"):
    """Hour bits of each kind and day, the hours of a window that are missing, its 64 segments (of their bits the lower half), and each hour's state."""
    e = events(spark, sf).where("value > 15").select(F.col("event_type").alias("name"), "ts")
    days = kept(coverage.day_hours(e, "ts", ["name"]), "hours")
    seen = F.bit_count("hours").cast("long")
    bits = days.select(F.lit("bits").alias("section"), F.concat_ws(" ", "name", F.col("day").cast("string")).alias("name"), F.col("hours").alias("bits"), seen.alias("seen"), (24 - seen).alias("missing"))
    hours_ = coverage.hour_coverage(days, ["name"], start, end).select(F.lit("hours").alias("section"), "name", F.lit(None).cast("long").alias("bits"), "seen", "missing")
    parts = coverage.segment_bits(e, "ts", ["name"], start, end).select(F.lit("segments").alias("section"), "name", F.col("bits").bitwiseAND(F.lit((1 << 32) - 1)).alias("bits"), "seen", "missing")
    none = F.lit(None).cast("long")
    state = coverage.hour_states(days, "name", TYPES).select(F.lit("state").alias("section"), F.concat_ws(" ", F.col("day").cast("string"), F.lpad(F.col("hour").cast("string"), 2, "0")).alias("name"), F.col("state").cast("long").alias("bits"), none.alias("seen"), none.alias("missing"))
    return bits.union(hours_).union(parts).union(state)
