"""What a station teaches about itself: bindings of the learning operators to the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import HOUR
from ..operators import learn as op
from ..operators import series as so
from ..registry import query
from ..sources.bindings import OBSERVED, WIDE15, events, observed, wide15

R = lambda c, n=6: F.round(c, n)

# A station per ten users: counters of two kinds of events, power of two others.
_STATION = """st AS (SELECT user_id % 10 AS key, ts AS time, CASE WHEN event_type = 'purchase' THEN sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value) AS BIGINT) END) OVER w % 500 END AS a,
CASE WHEN event_type = 'signup' THEN sum(CASE WHEN event_type = 'signup' THEN CAST(round(value) AS BIGINT) END) OVER w % 300 END AS b, CASE WHEN event_type = 'click' THEN value - 15 END AS ac, CASE WHEN event_type = 'error' THEN value END AS dc
FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


def station(spark, sf):
    """key, time, two counters that are reset, two powers: a value a row, the others null."""
    of = lambda t, c="value": F.when(F.col("event_type") == t, F.col(c))
    e = events(spark, sf).withColumn("key", F.col("user_id") % 10)
    w = so.running("key", "ts")
    count = lambda t, m: F.when(F.col("event_type") == t, F.sum(F.round(of(t)).cast("long")).over(w) % m)
    return e.select("key", F.col("ts").alias("time"), count("purchase", 500).alias("a"), count("signup", 300).alias("b"), (of("click") - 15).alias("ac"), of("error").alias("dc"))


ENERGY = f"""{_STATION}, dd AS (SELECT *, CAST(time AS DATE) AS day FROM st),
ga AS (SELECT *, last_value(a IGNORE NULLS) OVER p AS pa, last_value(b IGNORE NULLS) OVER p AS pb FROM dd WINDOW p AS (PARTITION BY key, day ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gb AS (SELECT key, time, CASE WHEN a IS NOT NULL THEN sum(CASE WHEN a IS NOT NULL THEN coalesce(greatest(a - pa, 0), 0) END) OVER q END AS a_gain, CASE WHEN b IS NOT NULL THEN sum(CASE WHEN b IS NOT NULL THEN coalesce(greatest(b - pb, 0), 0) END) OVER q END AS b_gain FROM ga WINDOW q AS (PARTITION BY key, day ORDER BY time ROWS UNBOUNDED PRECEDING)),
pw AS (SELECT key, time, day, greatest(0, coalesce(ac, 0) + coalesce(dc, 0)) AS p FROM dd WHERE ac IS NOT NULL OR dc IS NOT NULL),
pe AS (SELECT *, coalesce((p + lag(p) OVER w) / 2 * (epoch_us(time) - lag(epoch_us(time)) OVER w) / 3600000000 / 1000, 0) AS e FROM pw WINDOW w AS (PARTITION BY key, day ORDER BY time)),
al AS (SELECT key, time, a_gain, b_gain, CASE WHEN a_gain IS NOT NULL OR b_gain IS NOT NULL THEN coalesce(a_gain, 0) + coalesce(b_gain, 0) END AS generated, NULL::DOUBLE AS used_kwh FROM gb UNION ALL
SELECT key, time, NULL, NULL, NULL, sum(e) OVER (PARTITION BY key, day ORDER BY time ROWS UNBOUNDED PRECEDING) FROM pe),
energy AS (SELECT key, time_bucket(INTERVAL 15 minute, time) AS time, CAST(arg_max(a_gain, time) FILTER (a_gain IS NOT NULL) AS BIGINT) AS a_gain, CAST(arg_max(b_gain, time) FILTER (b_gain IS NOT NULL) AS BIGINT) AS b_gain, CAST(arg_max(generated, time) FILTER (generated IS NOT NULL) AS BIGINT) AS generated, arg_max(used_kwh, time) FILTER (used_kwh IS NOT NULL) AS used_kwh FROM al GROUP BY 1, 2)"""


def energy(spark, sf):
    return op.energy_display(station(spark, sf), "key", "time", ["a", "b"], ["ac", "dc"], 15)


@query(f"WITH {ENERGY} SELECT key, time, a_gain, b_gain, generated, round(used_kwh, 6) AS used_kwh FROM energy WHERE coalesce(a_gain, b_gain, generated, used_kwh) IS NOT NULL")
def e6_generated_and_used(spark, sf):
    return energy(spark, sf).select("key", "time", "a_gain", "b_gain", "generated", R("used_kwh").alias("used_kwh"))


@query("""WITH s AS (SELECT user_id AS key, floor(median(d)) AS step FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) WHERE d > 0 GROUP BY 1),
i AS (SELECT user_id AS key, ts, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 1 ELSE 0 END AS ch FROM events),
r AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM i), g AS (SELECT key, run, min(ts) AS start, max(ts) AS z, any_value(event_type) AS label, count(*) AS n FROM r GROUP BY 1, 2),
l AS (SELECT *, lead(start) OVER (PARTITION BY key ORDER BY start) AS next FROM g)
SELECT l.key, start, coalesce(next, make_timestamp(epoch_us(z) + CAST(coalesce(step, 3600000000) AS BIGINT))) AS stop, label, n FROM l LEFT JOIN s ON l.key = s.key WHERE label <> 'view'""")
def e14_mode_intervals(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), F.col("event_type").alias("label"))
    return op.intervals(e, "key", "time", "label", idle="view")


_BOUNDARY = """sm AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n, median(v) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sv FROM runs WINDOW w AS (PARTITION BY {keys} ORDER BY ts)),
fr AS (SELECT *, list(sv) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lb, list(sv) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS la FROM sm),
md AS (SELECT *, list_median(lb) AS mb, list_median(la) AS ma FROM fr WHERE n >= 12 AND i >= 4 AND i <= least(n - 4, floor({limit} / greatest(cadence, 1)))),
sc AS (SELECT *, abs(mb - ma) AS d, greatest(3, 1.4826 * list_median([abs(x - mb) for x in lb])) AS sb, greatest(3, 1.4826 * list_median([abs(x - ma) for x in la])) AS sa FROM md),
ok AS (SELECT {keys}, arg_max(i, (d, -i)) AS i, max(d) AS d FROM sc WHERE d >= greatest({least}, 0.08 * greatest(least(mb, ma), 1), 3 * greatest(sb, sa)) GROUP BY {keys}),
bd AS (SELECT r.*, CAST(coalesce(ok.i, 0) AS INT) AS boundary, ok.d AS change FROM (SELECT DISTINCT {keys} FROM runs) r LEFT JOIN ok USING ({keys}))"""


@query("WITH runs AS (SELECT user_id AS key, ts, value AS v, 15 AS cadence FROM events), " + _BOUNDARY.format(keys="key", limit=720, least=5) + " SELECT key, boundary, round(change, 6) AS change FROM bd")
def e15_startup_boundary(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), "value")
    return op.startup_boundary(e, ["key"], "time", "value", 15, least=5.0).select("key", "boundary", R("change").alias("change"))


@query("""WITH q AS (SELECT user_id AS key, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS z, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1),
d AS (SELECT DISTINCT user_id AS key, value AS v FROM events WHERE value >= 0), k AS (SELECT d.key, v FROM d JOIN q ON d.key = q.key WHERE n >= 20 AND v BETWEEN a AND z), g AS (SELECT key, v, lead(v) OVER (PARTITION BY key ORDER BY v) AS u FROM k),
b AS (SELECT key, arg_max(v, (ln(1 + u) - ln(1 + v), -v)) AS low, arg_max(u, (ln(1 + u) - ln(1 + v), -v)) AS high FROM g WHERE u IS NOT NULL GROUP BY 1)
SELECT q.key, round(CASE WHEN (high + 1) / (low + 1) >= 1.5 THEN exp((ln(1 + low) + ln(1 + high)) / 2) - 1 END, 5) AS threshold FROM q LEFT JOIN b ON q.key = b.key""")
def e17_log_gap_threshold(spark, sf):
    """The ratio is lower than a load's, as these values lie closer."""
    return op.log_gap_threshold(events(spark, sf).select(F.col("user_id").alias("key"), "value"), "key", "value", ratio=1.5).select("key", F.round("threshold", 5).alias("threshold"))


@query("""WITH s AS (SELECT user_id AS key, ts, value, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS d FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS rn FROM s WHERE d IS NULL OR d >= 7200000000)
SELECT key, count(*) AS n, round(median(value), 6) AS level, arg_max(value, ts) AS latest FROM t WHERE rn <= 168 GROUP BY 1""")
def e21_spaced_registry(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), "value")
    return op.spaced_registry(e, "key", "time", "value", 2 * HOUR).select("key", "n", R("level").alias("level"), "latest")


_Q3 = "round(quantile_cont({0}, 0.1), 6) AS {1}p10, round(quantile_cont({0}, 0.5), 6) AS {1}p50, round(quantile_cont({0}, 0.9), 6) AS {1}p90"


@query(f"""WITH base AS (SELECT event_type AS tier, median(value) AS p50 FROM events WHERE value <= 10 AND event_type IN ('click', 'signup') GROUP BY 1), tiers AS (SELECT unnest(['click', 'signup', 'view', 'none']) AS tier),
m AS (SELECT user_id % 10 AS st, ts, event_type AS tier, value, value > 10 AS on_, lag(value > 10) OVER w AS p, lag(event_type) OVER w AS pt, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts)),
s AS (SELECT *, CASE WHEN coalesce(p AND pt = tier AND d <= 14400000000, false) THEN 0 ELSE 1 END AS start FROM m WHERE on_), e AS (SELECT *, sum(start) OVER (PARTITION BY st, tier ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ep FROM s),
i AS (SELECT e.tier, {_Q3.format("greatest(0, value - coalesce(p50, 0))", "")}, count(*) AS n, CAST(sum(start) AS BIGINT) AS episodes FROM e LEFT JOIN base ON e.tier = base.tier GROUP BY 1),
d AS (SELECT tier, {_Q3.format("h", "dur_")} FROM (SELECT tier, st, ep, count(*) * 0.25 AS h FROM e GROUP BY 1, 2, 3) GROUP BY 1),
j AS (SELECT t.tier, coalesce(i.p10, 400) AS p10, coalesce(i.p50, 400) AS p50, coalesce(i.p90, 400) AS p90, coalesce(n, 0) AS n, coalesce(episodes, 0) AS episodes, coalesce(n * 0.25, 0) AS hours, coalesce(dur_p10, 1) AS dur_p10, coalesce(dur_p50, 1) AS dur_p50, coalesce(dur_p90, 1) AS dur_p90,
CASE WHEN n IS NULL THEN 'estimated' WHEN episodes >= 1 AND n * 0.25 >= 2.5 AND b.tier IS NOT NULL THEN 'reliable' ELSE 'provisional' END AS maturity FROM tiers t LEFT JOIN i ON i.tier = t.tier LEFT JOIN d ON d.tier = t.tier LEFT JOIN base b ON b.tier = t.tier)
SELECT tier, p10, p50, p90, n, episodes, hours, dur_p10, dur_p50, dur_p90, CASE WHEN maturity = 'reliable' THEN dur_p50 ELSE 1 END AS duration, maturity FROM j""")
def a30_charge_increment(spark, sf):
    e = events(spark, sf).select((F.col("user_id") % 10).alias("st"), "ts", F.col("event_type").alias("tier"), "value", (F.col("value") > 10).alias("on"))
    base = e.where("NOT on AND tier IN ('click', 'signup')").groupBy("tier").agg(F.median("value").alias("p50"))
    tiers = spark.createDataFrame([("click",), ("signup",), ("view",), ("none",)], "tier string")
    p = op.increment_profile(e, base, tiers, "st", "ts", "tier", "value", "on", gap_us=4 * HOUR)
    return p.select("tier", *[R(c).alias(c) for c in ("p10", "p50", "p90")], "n", "episodes", "hours", *[R(c).alias(c) for c in ("dur_p10", "dur_p50", "dur_p90", "duration")], "maturity")


_ROBUST = """{0}1 AS (SELECT *, list_median(l) AS md FROM {0}), {0}2 AS (SELECT *, greatest(3, 1.4826 * list_median([abs(x - md) for x in l])) AS sd FROM {0}1), {0}3 AS (SELECT *, [x for x in l if abs(x - md) <= greatest(5 * sd, 20)] AS r FROM {0}2),
{0}4 AS (SELECT *, list_median(r) AS loc FROM {0}3), {0}5 AS (SELECT *, greatest(3, 1.4826 * list_median([abs(x - loc) for x in r])) AS scale, len(r) AS n FROM {0}4)"""


@query(f"""WITH v AS (SELECT user_id AS key, value AS v FROM events), g AS (SELECT key, v, lead(v) OVER (PARTITION BY key ORDER BY v) - v AS gap FROM v),
c AS (SELECT key, arg_max(v, (gap, -v)) AS low, max(gap) AS gap, count(*) AS total FROM g GROUP BY 1), s AS (SELECT v.key, CASE WHEN v > low THEN 1 ELSE 0 END AS regime, list(v) AS l, any_value(gap) AS gap, any_value(total) AS total FROM v JOIN c ON v.key = c.key GROUP BY 1, 2),
{_ROBUST.format("s")}, t AS (SELECT key, count(*) = 2 AND min(len(l)) >= 4 AND max(gap) >= greatest(20, 3 * sqrt(sum(scale * scale))) AS two FROM s5 GROUP BY 1),
w0 AS (SELECT v.key, list(v) AS l FROM v JOIN t ON v.key = t.key WHERE NOT coalesce(two, false) GROUP BY 1), {_ROBUST.format("w0")}, o AS (SELECT key, r AS l FROM w05), {_ROBUST.format("o")},
a AS (SELECT s5.key, regime, loc, scale, n * 1.0::DOUBLE / total AS weight, n FROM s5 JOIN t ON s5.key = t.key WHERE two UNION ALL SELECT key, 0, loc, scale, n * 1.0::DOUBLE / len(l), n FROM o5),
b AS (SELECT *, weight / sum(weight) OVER (PARTITION BY key) AS sh FROM a), d AS (SELECT *, sum(sh * loc) OVER (PARTITION BY key) AS mean FROM b)
SELECT key, regime, round(loc, 6) AS location, round(scale, 6) AS scale, round(weight, 6) AS weight, n, round(mean, 6) AS mean, round(sum(sh * (scale * scale + (loc - mean) * (loc - mean))) OVER (PARTITION BY key), 4) AS variance FROM d""")
def a31_regime_split(spark, sf):
    r = op.regimes(events(spark, sf).select(F.col("user_id").alias("key"), "value"), "key", "value")
    return r.select("key", "regime", *[R(c).alias(c) for c in ("location", "scale", "weight")], "n", R("mean").alias("mean"), R("variance", 4).alias("variance"))


@query(f"""WITH {WIDE15}, s AS (SELECT time, click AS soc, (view - error) * 300 AS w, purchase AS load FROM wide15), rc AS (SELECT * FROM s WHERE time >= (SELECT max(time) FROM s) - INTERVAL 30 day),
h AS (SELECT time_bucket(INTERVAL 30 minute, time) AS t, median(soc) AS soc, median(w) AS p, median(load) AS l FROM rc GROUP BY 1 HAVING median(soc) IS NOT NULL AND median(w) IS NOT NULL),
st AS (SELECT *, lag(soc) OVER o AS s0, soc - lag(soc) OVER o AS d, (epoch_us(t) - lag(epoch_us(t)) OVER o) / 3600000000.0::DOUBLE AS h, (p + lag(p) OVER o) / 2 AS w, coalesce(abs(l - lag(l) OVER o), 0) AS dl FROM h WINDOW o AS (ORDER BY t)),
u AS (SELECT *, abs(w) * h / 1000 AS e FROM st WHERE soc BETWEEN 5 AND 95 AND s0 BETWEEN 5 AND 95 AND h BETWEEN 0.25 AND 1.5 AND abs(d) >= 0.2 AND dl <= 100 AND ((d > 0 AND w > 25) OR (d < 0 AND w < -25))),
c AS (SELECT CASE WHEN d > 0 THEN e * 0.92::DOUBLE * 100 / abs(d) ELSE e * 100 / (0.92::DOUBLE * abs(d)) END AS cap FROM u), k AS (SELECT (SELECT count(*) FROM u) AS n, CASE WHEN count(*) >= 6 THEN median(cap) ELSE 26 END AS capacity FROM c WHERE cap BETWEEN 15 AND 35),
f AS (SELECT CASE WHEN d > 0 THEN abs(d) * capacity / 100 / e END AS ce, CASE WHEN d < 0 THEN e / (abs(d) * capacity / 100) END AS de FROM u, k),
ef AS (SELECT (SELECT CASE WHEN count(*) >= 3 THEN median(ce) ELSE 0.92 END FROM f WHERE ce BETWEEN 0.65 AND 1.05) AS ce, (SELECT CASE WHEN count(*) >= 3 THEN median(de) ELSE 0.92 END FROM f WHERE de BETWEEN 0.65 AND 1.05) AS de),
lm AS (SELECT (SELECT CASE WHEN count(*) >= 4 THEN greatest(100, 1.1::DOUBLE * quantile_cont(w, 0.995)) ELSE 3000 END FROM rc WHERE w > 0) AS up, (SELECT CASE WHEN count(*) >= 4 THEN greatest(100, 1.1::DOUBLE * quantile_cont(-w, 0.995)) ELSE 3000 END FROM rc WHERE w < 0) AS down),
z AS (SELECT (SELECT count(*) FROM h) >= 3 AS ok)
SELECT 0 AS key, CASE WHEN ok AND n >= 4 THEN n ELSE 0 END AS n, round(CASE WHEN ok AND n >= 4 THEN capacity ELSE 26 END, 6) AS capacity, round(CASE WHEN ok AND n >= 4 THEN ce ELSE 0.92 END, 6) AS charge_efficiency, round(CASE WHEN ok AND n >= 4 THEN de ELSE 0.92 END, 6) AS discharge_efficiency,
round(CASE WHEN ok THEN up ELSE 3000 END, 6) AS max_charge, round(CASE WHEN ok THEN down ELSE 3000 END, 6) AS max_discharge, CASE WHEN ok AND n >= 12 THEN 'calibrated' WHEN ok AND n >= 4 THEN 'provisional' ELSE 'default' END AS confidence FROM k, ef, lm, z""")
def a33_battery_calibration(spark, sf):
    """One station: the 15-minute medians are its state."""
    w = wide15(spark, sf).select(F.lit(0).alias("key"), "time", F.col("click").alias("soc"), ((F.col("view") - F.col("error")) * 300).alias("w"), F.col("purchase").alias("load"))
    m = op.battery_model(w, "key", "time", "soc", "w", "load")
    return m.select("key", "n", *[R(c).alias(c) for c in ("capacity", "charge_efficiency", "discharge_efficiency", "max_charge", "max_discharge")], "confidence")


_PHASES = """mp AS (SELECT user_id % 5 AS scenario, date_trunc('hour', ts) AS time, user_id % 3 AS member, list_position(['click', 'error', 'purchase', 'signup', 'view'], arg_max(event_type, ts)) AS phase FROM events GROUP BY 1, 2, 3),
mo AS (SELECT user_id % 5 AS scenario, date_trunc('hour', ts) AS time, CAST(count_if(event_type = 'signup') > 0 AS INT) AS mode FROM events GROUP BY 1, 2)"""


def _member_phases(spark, sf):
    from ..sources.bindings import TYPES

    e = events(spark, sf).select((F.col("user_id") % 5).alias("scenario"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), (F.col("user_id") % 3).alias("member"), "event_type", "ts")
    phase = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.max_by("event_type", "ts")).cast("int")
    mode = e.groupBy("scenario", "time").agg((F.count_if(F.col("event_type") == "signup") > 0).cast("int").alias("mode"))
    return e.groupBy("scenario", "time", "member").agg(phase.alias("phase")).join(mode, ["scenario", "time"]), mode


@query(f"""WITH {_PHASES}, f AS (SELECT *, phase <> lag(phase) OVER (PARTITION BY scenario, member ORDER BY time) AS ch FROM mp), v AS (SELECT scenario, time, phase, count(*) AS n, bool_or(coalesce(ch, false)) AS ch FROM f GROUP BY 1, 2, 3),
o AS (SELECT scenario, time, arg_max(phase, (n, -phase)) AS phase, bool_or(ch) AS ch FROM v GROUP BY 1, 2), m AS (SELECT o.*, mode, CASE WHEN coalesce(ch OR mode <> lag(mode) OVER (PARTITION BY o.scenario ORDER BY o.time), false) THEN 1 ELSE 0 END AS moved FROM o JOIN mo ON o.scenario = mo.scenario AND o.time = mo.time),
s AS (SELECT *, mode = 1 AS on_, lag(mode = 1) OVER (PARTITION BY scenario ORDER BY time) AS p, row_number() OVER (PARTITION BY scenario ORDER BY time) AS i FROM mo),
k AS (SELECT scenario, count_if(on_ AND NOT coalesce(p, false)) AS starts, min(time) FILTER (on_ AND NOT coalesce(p, false)) AS first_start, max(time) FILTER (NOT on_ AND coalesce(p, false)) AS last_stop, count_if(on_ AND i > 1) AS on_hours FROM s GROUP BY 1)
SELECT m.scenario, m.time, CAST(m.phase AS INT) AS phase, CAST(sum(moved) OVER (PARTITION BY m.scenario ORDER BY m.time ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch, starts, first_start, last_stop, on_hours FROM m JOIN k ON m.scenario = k.scenario""")
def a49_majority_phase(spark, sf):
    rows, modes = _member_phases(spark, sf)
    of = op.on_summary(modes.withColumn("on", F.col("mode") == 1), "scenario", "time", "on").withColumnRenamed("on_steps", "on_hours")
    return op.majority_phase(rows, "scenario", "time", "member", "phase", "mode").join(of, "scenario").select("scenario", "time", "phase", "epoch", "starts", "first_start", "last_stop", "on_hours")


@query(f"""WITH {OBSERVED}, o AS (SELECT time, obs - 10 AS v FROM observed), d AS (SELECT CAST(floor(median(epoch_us(time) - epoch_us(p))) AS BIGINT) AS step FROM (SELECT time, lag(time) OVER (ORDER BY time) AS p FROM o) WHERE p IS NOT NULL),
b AS (SELECT epoch_us(min(time)) AS a, epoch_us(max(time)) AS z, arg_max(v, time) AS last, CASE WHEN (SELECT step FROM d) > 0 THEN (SELECT step FROM d) ELSE 10800000000 END AS step, epoch_us(max(time)) + 110700000000 AS h FROM o),
t AS (SELECT DISTINCT a, z, last, unnest(list_concat(range(z + step, h + 1, step), [h])) AS tgt FROM b), f AS (SELECT *, tgt - 86400000000 * CAST(ceil((tgt - z) / 86400000000.0::DOUBLE) AS BIGINT) AS src, make_timestamp(tgt - 86400000000 * CAST(ceil((tgt - z) / 86400000000.0::DOUBLE) AS BIGINT)) AS st FROM t),
bk AS (SELECT f.*, o.time AS bt, o.v AS bv FROM f ASOF LEFT JOIN o ON f.st >= o.time), nx AS (SELECT bk.*, o.time AS nt, o.v AS nv FROM bk ASOF LEFT JOIN o ON bk.st <= o.time)
SELECT make_timestamp(tgt) AS time, round(greatest(0, CASE WHEN src < a THEN last WHEN nt IS NULL OR nt = bt THEN bv ELSE bv + (src - epoch_us(bt))::DOUBLE / (epoch_us(nt) - epoch_us(bt)) * (nv - bv) END), 6) AS v FROM nx""")
def e33_diurnal_extension(spark, sf):
    o = observed(spark, sf).select(F.lit(0).alias("key"), "time", (F.col("obs") - 10).alias("v"))
    end = o.groupBy("key").agg((F.max("time") + F.make_dt_interval(hours=F.lit(30), mins=F.lit(45))).alias("horizon"))
    return op.diurnal_extension(o, "key", "time", "v", end).select("time", R("v").alias("v"))


_POLY = """t AS (SELECT user_id AS key, (epoch_us(ts) - max(epoch_us(ts)) OVER (PARTITION BY user_id)) / 60000000.0::DOUBLE / 1440 AS x, value AS y FROM events),
g AS (SELECT key, CAST(count(*) AS DOUBLE) AS n, sum(x) AS x1, sum(x*x) AS x2, sum(x*x*x) AS x3, sum(x*x*x*x) AS x4, sum(y) AS y0, sum(x*y) AS y1, sum(x*x*y) AS y2 FROM t WHERE x >= -10 GROUP BY 1 HAVING count(*) >= 2),
l AS (SELECT *, (n*y1 - x1*y0) / nullif(n*x2 - x1*x1, 0) AS k, nullif(n*(x2*x4 - x3*x3) - x1*(x1*x4 - x2*x3) + x2*(x1*x3 - x2*x2), 0) AS det FROM g),
c AS (SELECT key, CASE WHEN n > 2 AND det IS NOT NULL THEN (y0*(x2*x4 - x3*x3) - x1*(y1*x4 - y2*x3) + x2*(y1*x3 - y2*x2)) / det ELSE (y0 - k*x1) / n END AS c0,
CASE WHEN n > 2 AND det IS NOT NULL THEN (n*(y1*x4 - y2*x3) - y0*(x1*x4 - x2*x3) + x2*(x1*y2 - x2*y1)) / det ELSE k END AS c1, CASE WHEN n > 2 AND det IS NOT NULL THEN (n*(x2*y2 - x3*y1) - x1*(x1*y2 - x2*y1) + y0*(x1*x3 - x2*x2)) / det ELSE 0 END AS c2 FROM l)"""


@query(f"WITH {_POLY} SELECT key, a AS ahead, round(least(100, greatest(0, c0 + c1 * (a / 1440) + c2 * (a / 1440) * (a / 1440))), 4) AS projected FROM c, (SELECT unnest([0.0::DOUBLE, 60, 180, 720, 1440]) AS a)")
def e35_projection(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), "value")
    return op.projection(e, "key", "time", "value", 14400, 2, (0, 60, 180, 720, 1440)).select("key", "ahead", R("projected", 4).alias("projected"))


@query("""WITH s AS (SELECT user_id AS key, ts, CASE WHEN user_id % 17 <> 5 OR event_id % 40 <> 0 THEN least(100, 30 + value * 3) END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events),
f AS (SELECT *, r - 1 AS i FROM s WHERE r <= 97), g AS (SELECT key, count(*) AS n, count(v) AS nv, max(v) FILTER (i = 0) AS v0, min(i) FILTER (i >= 1 AND v < 90 - 1e-9) AS dip FROM f GROUP BY 1),
b AS (SELECT g.key, min(i) AS back FROM f JOIN g ON f.key = g.key WHERE v >= 90 - 1e-9 AND i >= CASE WHEN v0 >= 90 THEN dip + 1 ELSE 1 END GROUP BY 1),
a AS (SELECT g.*, v0 >= 90 AND dip IS NULL AS stays, CASE WHEN v0 >= 90 AND dip IS NULL THEN n - 1 ELSE back END AS tgt FROM g LEFT JOIN b ON g.key = b.key),
l AS (SELECT a.key, any_value(n) AS n, any_value(nv) AS nv, any_value(stays) AS stays, any_value(tgt) AS tgt, min(v) FILTER (tgt IS NULL OR i <= tgt) AS low, max(ts) FILTER (i = tgt) AS rt FROM a JOIN f ON a.key = f.key GROUP BY 1),
r AS (SELECT *, CASE WHEN n < 2 OR nv < n THEN 'insufficient_forecast' WHEN tgt IS NULL THEN 'does_not_recover' WHEN low < 33 - 1e-9 THEN 'breaches_minimum' WHEN stays THEN 'stays' ELSE 'recovers' END AS reason FROM l)
SELECT key, reason IN ('stays', 'recovers') AS eligible, reason, CASE WHEN reason <> 'insufficient_forecast' THEN rt END AS recovery_time, round(CASE WHEN reason <> 'insufficient_forecast' THEN low END, 6) AS low FROM r""")
def e39_continuation_rule(spark, sf):
    v = F.when((F.col("user_id") % 17 != 5) | (F.col("event_id") % 40 != 0), F.least(F.lit(100.0), 30 + F.col("value") * 3))
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), v.alias("v"))
    return op.continuation(e, "key", "time", "v", 90.0, 33.0).withColumn("low", R("low"))
