"""Load phases: bindings of the phase operators to the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import HOUR, bucket
from ..operators import learn, phases
from ..operators import series as so
from ..registry import query
from ..sources import scratch
from ..sources.bindings import events
from .learning import _BOUNDARY, _ROBUST

R = lambda c, n=6: F.round(c, n)
_ON = "key, state"
_RUN = "key, state, run"


def learned_sql(base: str, gap: float, limit: float, least: float) -> str:
    """CTEs that end in `learned`, from one `base` that makes v (key, ts, v, state): the rules of operators.phases.phase_learning."""
    q = lambda ok, n: f"quantile_cont(v, [0.1, 0.5, 0.9]) FILTER ({ok}) AS {n}"
    scale = lambda l, m: f"greatest(3, 1.4826 * list_median([abs(x - {m}) for x in {l}]))"
    differ = lambda a, b, sa, sb: f"abs({a} - {b}) >= greatest({least}, 0.08 * greatest(least({a}, {b}), 1), 3 * greatest({sa}, {sb}))"
    return f"""{base},
cd AS (SELECT key, CASE WHEN m > 0 THEN greatest(1, m / 60000000) ELSE 15 END AS cadence FROM (SELECT key, median(d) AS m FROM (SELECT key, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY key ORDER BY ts) AS d FROM v) GROUP BY 1)),
rf AS (SELECT v.*, cadence, CASE WHEN lag(ts) OVER w IS NULL OR state IS DISTINCT FROM lag(state) OVER w OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > greatest(cadence * {gap} * 60000000, 1800000000) THEN 1 ELSE 0 END AS nw FROM v JOIN cd ON v.key = cd.key WINDOW w AS (PARTITION BY v.key ORDER BY ts)),
runs AS (SELECT key, ts, v, state, cadence, sum(nw) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM rf),
{_BOUNDARY.format(keys=_RUN, limit=limit, least=least)},
r AS (SELECT runs.*, boundary, row_number() OVER (PARTITION BY {_RUN} ORDER BY ts) AS i1 FROM runs JOIN bd USING ({_RUN})), sd AS (SELECT * FROM r WHERE i1 > boundary), be AS (SELECT * FROM r WHERE i1 <= boundary),
gp AS (SELECT {_ON}, v, lead(v) OVER (PARTITION BY {_ON} ORDER BY v) - v AS gap FROM sd), ct AS (SELECT {_ON}, arg_max(v, (gap, -v)) AS cut FROM gp WHERE gap IS NOT NULL GROUP BY 1, 2),
sides AS (SELECT {_ON}, list(v) FILTER (NOT coalesce(v > cut, false)) AS ll, list(v) FILTER (coalesce(v > cut, false)) AS lh, any_value(cut) AS cut FROM sd LEFT JOIN ct USING ({_ON}) GROUP BY 1, 2),
t1 AS (SELECT *, list_median(ll) AS ml, list_median(lh) AS mh FROM sides), t2 AS (SELECT *, {scale("ll", "ml")} AS sl, {scale("lh", "mh")} AS sh FROM t1),
sp AS (SELECT {_ON}, cut, ml, mh, coalesce(len(ll) >= 4 AND len(lh) >= 4 AND {differ("ml", "mh", "sl", "sh")}, false) AS apart FROM t2),
l0 AS (SELECT sd.*, CASE WHEN abs(v - ml) <= abs(v - mh) THEN 'low' ELSE 'high' END AS label FROM sd JOIN sp USING ({_ON}) WHERE apart), l1 AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY {_RUN} ORDER BY ts) THEN 1 ELSE 0 END AS nw FROM l0),
l2 AS (SELECT *, sum(nw) OVER (PARTITION BY {_RUN} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seg FROM l1), l3 AS (SELECT *, count(*) OVER (PARTITION BY {_RUN}, seg) AS sn, count(*) OVER (PARTITION BY {_RUN}) AS al, max(CASE WHEN seg = 2 THEN label END) OVER (PARTITION BY {_RUN}) AS sec FROM l2),
l4 AS (SELECT {_RUN}, ts, CASE WHEN al < 3 THEN label ELSE coalesce(last_value(CASE WHEN sn >= 2 THEN label END IGNORE NULLS) OVER (PARTITION BY {_RUN} ORDER BY ts ROWS UNBOUNDED PRECEDING), sec, label) END AS fine FROM l3),
l5 AS (SELECT *, CASE WHEN fine IS DISTINCT FROM lag(fine) OVER (PARTITION BY {_RUN} ORDER BY ts) THEN 1 ELSE 0 END AS nw FROM l4), l6 AS (SELECT {_ON}, count_if(nw = 1 AND fine = 'low') AS lows, count_if(nw = 1 AND fine = 'high') AS highs, arg_max(fine, ts) AS latest FROM l5 GROUP BY 1, 2),
kd AS (SELECT sp.*, latest, coalesce(apart AND lows >= 2 AND highs >= 2, false) AS bth FROM sp LEFT JOIN l6 USING ({_ON})),
td AS (SELECT sd.*, cut, ml, mh, apart, latest, bth, CASE WHEN bth THEN fine ELSE 'steady' END AS label FROM sd JOIN kd USING ({_ON}) LEFT JOIN l4 USING ({_RUN}, ts)),
lv AS (SELECT {_ON}, {q("bth AND v <= cut", "ql")}, {q("bth AND v > cut", "qh")}, {q("NOT bth AND (NOT apart OR CASE WHEN v <= (ml + mh) / 2 THEN 'low' ELSE 'high' END = latest)", "qs")} FROM td GROUP BY 1, 2),
bm AS (SELECT {_ON}, list(v) AS bl, list_median(list(v)) AS bmed, quantile_cont(v, [0.1, 0.5, 0.9]) AS qb FROM be GROUP BY 1, 2), am AS (SELECT {_ON}, list(v) AS al, list_median(list(v)) AS amed FROM sd GROUP BY 1, 2),
du AS (SELECT {_ON}, quantile_cont(m, [0.1, 0.5, 0.9]) AS dur, count(*) AS starts FROM (SELECT {_RUN}, count(*) * max(cadence) AS m FROM be GROUP BY 1, 2, 3) GROUP BY 1, 2),
su AS (SELECT {_ON}, qb, dur FROM bm JOIN am USING ({_ON}) JOIN du USING ({_ON}) WHERE starts >= 2 AND {differ("bmed", "amed", scale("bl", "bmed"), scale("al", "amed"))}),
f1 AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY {_RUN} ORDER BY ts) THEN 1 ELSE 0 END AS nw FROM td), f2 AS (SELECT *, sum(nw) OVER (PARTITION BY {_RUN} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seg FROM f1),
fs AS (SELECT {_RUN}, seg, any_value(label) AS label, count(*) AS n, min(ts) AS start, max(cadence) AS cadence, max(boundary) AS boundary FROM f2 GROUP BY 1, 2, 3, 4),
sh AS (SELECT {_ON}, {", ".join(f"coalesce(sum(n) FILTER (label = '{p}'), 0) AS n_{p}, coalesce(median(n * cadence) FILTER (label = '{p}'), max(cadence)) AS d_{p}" for p in ("low", "high", "steady"))}, count(*) - count_if(seg = 1 AND boundary = 0) AS changes FROM fs GROUP BY 1, 2),
wh AS (SELECT {_ON}, count(*) AS samples, count(DISTINCT run) AS episodes, max(ts) AS lastt FROM r GROUP BY 1, 2),
rn AS (SELECT {_RUN}, min(ts) AS began, max(ts) AS ended, max(boundary) AS bound, max(cadence) AS cad FROM r GROUP BY 1, 2, 3), en AS (SELECT * FROM rn QUALIFY ended = max(ended) OVER (PARTITION BY key)),
tl AS (SELECT {_RUN}, arg_max(label, seg) AS at_end, max(start) FILTER (seg > 1 OR boundary > 0) AS turned FROM fs GROUP BY 1, 2, 3), cu AS (SELECT {_ON}, began, ended, bound, cad, at_end, coalesce(turned, began) AS turned FROM en JOIN tl USING ({_RUN})),
jn AS (SELECT *, coalesce(qb IS NOT NULL AND bound = 0 AND (epoch_us(ended) - epoch_us(began)) / 60000000 + cad <= greatest(dur[3], dur[2], cad), false) AS fresh, greatest(n_low + n_high + n_steady, 1) AS al FROM wh JOIN kd USING ({_ON}) JOIN lv USING ({_ON}) JOIN sh USING ({_ON}) LEFT JOIN su USING ({_ON}) LEFT JOIN cu USING ({_ON})),
learned AS (SELECT {_ON}, CASE WHEN fresh THEN 'startup' ELSE coalesce(at_end, CASE WHEN bth THEN 'low' ELSE 'steady' END) END AS current_phase, coalesce(began, lastt) AS state_started, CASE WHEN fresh THEN began ELSE coalesce(turned, lastt) END AS phase_started,
{", ".join(f"coalesce(dur[{i}], 0) AS startup_min_{n}" for i, n in ((1, "p10"), (2, "p50"), (3, "p90")))}, samples, episodes, changes,
{", ".join(f"CASE WHEN {ok} THEN n_{p} * 1.0::DOUBLE / al END AS {p}_weight, CASE WHEN {ok} THEN d_{p} END AS {p}_dwell" for p, ok in (("low", "bth"), ("high", "bth"), ("steady", "NOT bth")))},
{", ".join(f"{c}[{i}] AS {p}_{n}" for p, c in (("low", "ql"), ("high", "qh"), ("steady", "qs"), ("startup", "qb")) for i, n in ((1, "p10"), (2, "p50"), (3, "p90")))} FROM jn)"""


_NUMBERS = [f"startup_min_{n}" for n in ("p10", "p50", "p90")] + [f"{p}_{c}" for p in ("low", "high", "steady") for c in ("weight", "dwell")] + [f"{p}_{n}" for p in phases.PHASES for n in ("p10", "p50", "p90")]
_LEARNED = learned_sql("v AS (SELECT user_id AS key, ts, value AS v, CASE WHEN (day(ts) - 1) // 10 % 2 = 0 THEN 'a' ELSE 'b' END AS state FROM events WHERE value >= 0)", 8, 17280, 5)


def _learned(spark, sf):
    """Users as stations whose state turns every ten days; the cadence is hours, so the limits are longer than a load's."""
    state = F.when(F.expr("(day(ts) - 1) div 10 % 2") == 0, "a").otherwise("b")
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").alias("time"), "value", state.alias("state"))
    return phases.phase_learning(e, "key", "time", "value", "state", gap_factor=8, limit_minutes=17280, least=5)


@query(f"WITH {_LEARNED} SELECT key, state, current_phase, state_started, phase_started, samples, episodes, changes, " + ", ".join(f"round({c}, 5) AS {c}" for c in _NUMBERS) + " FROM learned")
def e19_phase_learning(spark, sf):
    return _learned(spark, sf).select("key", "state", "current_phase", "state_started", "phase_started", "samples", "episodes", "changes", *[R(c, 5).alias(c) for c in _NUMBERS])


_HEAVIEST = "CASE WHEN steady_p50 IS NOT NULL THEN 'steady' WHEN high_weight > low_weight THEN 'high' ELSE 'low' END"


@query(f"""WITH {_LEARNED}, cs AS (SELECT * FROM learned QUALIFY row_number() OVER (PARTITION BY key ORDER BY phase_started DESC, state) = 1), gr AS (SELECT user_id AS key, max(ts) AS z, unnest(generate_series(0, 95, 5)) AS h FROM events GROUP BY 1),
g AS (SELECT key, z + to_hours(CAST(h AS INT)) AS time FROM gr), p0 AS (SELECT g.time, cs.*, CASE WHEN current_phase = 'startup' AND startup_p50 IS NULL THEN {_HEAVIEST} ELSE current_phase END AS now FROM g JOIN cs ON g.key = cs.key),
p1 AS (SELECT *, CASE WHEN now = 'startup' AND epoch_us(time) > epoch_us(state_started) + startup_min_p50 * 60000000 THEN {_HEAVIEST} ELSE now END AS phase FROM p0)
SELECT key, time, phase, round(CASE WHEN phase = 'startup' THEN startup_p10 ELSE least(low_p10, high_p10, steady_p10) END, 5) AS p10, round(CASE phase WHEN 'low' THEN low_p50 WHEN 'high' THEN high_p50 WHEN 'startup' THEN startup_p50 ELSE steady_p50 END, 5) AS p50,
round(CASE WHEN phase = 'startup' THEN startup_p90 ELSE greatest(low_p90, high_p90, steady_p90) END, 5) AS p90 FROM p1""")
def e48_phase_load_path(spark, sf):
    """The path of each station over four days from its last sample, in the state that began a phase last."""
    from ..operators.clean import first_per_key

    now = first_per_key(_learned(spark, sf), ["key"], [F.desc("phase_started"), F.col("state")])
    ends = events(spark, sf).groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("z"))
    grid = ends.select("key", F.explode(F.sequence(F.lit(0), F.lit(95), F.lit(5))).alias("h"), "z").select("key", (F.col("z") + F.make_dt_interval(hours=F.col("h"))).alias("time"))
    return phases.load_path(grid, now, "key", "time").select("key", "time", "phase", *[R(c, 5).alias(c) for c in ("p10", "p50", "p90")])


_FRAME = """fr0 AS (SELECT user_id AS key, time_bucket(INTERVAL 15 minute, ts) AS ts, median(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2), sw AS (SELECT user_id AS key, ts, value > 20 AS sw FROM events WHERE event_type = 'signup'), vw AS (SELECT user_id AS key, ts, value AS w FROM events WHERE event_type = 'view'),
fr1 AS (SELECT f.*, coalesce(s.sw, false) AS sw FROM fr0 f ASOF LEFT JOIN sw s ON f.key = s.key AND f.ts >= s.ts), fb AS (SELECT f.*, w AS bw, epoch_us(f.ts) - epoch_us(s.ts) AS bd FROM fr1 f ASOF LEFT JOIN vw s ON f.key = s.key AND f.ts >= s.ts),
fn AS (SELECT f.*, s.w AS nw2, epoch_us(s.ts) - epoch_us(f.ts) AS nd FROM fb f ASOF LEFT JOIN vw s ON f.key = s.key AND f.ts <= s.ts), fo AS (SELECT key, ts, v, sw, CASE WHEN least(bd, nd) <= 21600000000 THEN CASE WHEN nd IS NOT NULL AND (bd IS NULL OR nd <= bd) THEN nw2 ELSE bw END END AS w FROM fn),
frame AS (SELECT *, CASE WHEN sw AND v >= 15 THEN 'active' WHEN sw THEN 'standby' ELSE 'off' END AS state, coalesce(w > 15, false) AS busy FROM fo)"""
_P7 = learned_sql(f"{_FRAME}, v AS (SELECT key, ts, v, state FROM frame WHERE v >= 0)", 8, 17280, 5)


@query(f"""WITH {_P7}, ep AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 86400000000 THEN 1 ELSE 0 END AS fresh FROM frame WINDOW w AS (PARTITION BY key ORDER BY ts)),
mds AS (SELECT state, count(*) AS n, CAST(sum(fresh) AS BIGINT) AS episodes, quantile_cont(v, [0.1, 0.5, 0.9]) AS q FROM ep GROUP BY 1),
gs AS (SELECT state, v, lead(v) OVER (PARTITION BY state ORDER BY v) - v AS gap FROM frame), gc AS (SELECT state, arg_max(v, (gap, -v)) AS low, max(gap) AS gap, count(*) AS total FROM gs GROUP BY 1), ga AS (SELECT f.state, CASE WHEN v > low THEN 1 ELSE 0 END AS regime, list(v) AS l, any_value(gap) AS gap, any_value(total) AS total FROM frame f JOIN gc ON f.state = gc.state GROUP BY 1, 2),
{_ROBUST.format("ga")}, gt AS (SELECT state, count(*) = 2 AND min(len(l)) >= 4 AND max(gap) >= greatest(20, 3 * sqrt(sum(scale * scale))) AS two FROM ga5 GROUP BY 1), gw AS (SELECT f.state, list(v) AS l FROM frame f JOIN gt ON f.state = gt.state WHERE NOT coalesce(two, false) GROUP BY 1), {_ROBUST.format("gw")}, go AS (SELECT state, r AS l FROM gw5), {_ROBUST.format("go")},
rg AS (SELECT ga5.state, regime, loc, scale, n * 1.0::DOUBLE / total AS weight, n FROM ga5 JOIN gt ON ga5.state = gt.state WHERE two UNION ALL SELECT state, 0, loc, scale, n * 1.0::DOUBLE / len(l), n FROM go5),
bs AS (SELECT state AS tier, median(v) AS p50 FROM frame WHERE NOT busy GROUP BY 1), im AS (SELECT *, lag(busy) OVER w AS p, lag(state) OVER w AS pt, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS d FROM frame WINDOW w AS (PARTITION BY key ORDER BY ts)),
ia AS (SELECT *, CASE WHEN coalesce(p AND pt = state AND d <= 86400000000, false) THEN 0 ELSE 1 END AS start FROM im WHERE busy), ig AS (SELECT state, count(*) AS n, CAST(sum(start) AS BIGINT) AS episodes, quantile_cont(greatest(0, v - coalesce(p50, 0)), [0.1, 0.5, 0.9]) AS q FROM ia LEFT JOIN bs ON bs.tier = state GROUP BY 1)
SELECT 'mode' AS section, state AS mode, NULL AS key, NULL AS part, n, episodes, round(q[1], 6) AS p10, round(q[2], 6) AS p50, round(q[3], 6) AS p90, NULL AS weight, CASE WHEN n >= 30 AND episodes >= 5 THEN 'mature' WHEN n >= 8 THEN 'learning' ELSE 'sparse' END AS grade FROM mds
UNION ALL SELECT 'regime', state, NULL, CAST(regime AS VARCHAR), n, NULL, NULL, round(loc, 6), NULL, round(weight, 6), NULL FROM rg
UNION ALL SELECT 'increment', state, NULL, NULL, n, episodes, round(q[1], 6), round(q[2], 6), round(q[3], 6), NULL, NULL FROM ig
UNION ALL SELECT 'phase', state, key, current_phase, samples, episodes, NULL, round(CASE current_phase WHEN 'low' THEN low_p50 WHEN 'high' THEN high_p50 WHEN 'startup' THEN startup_p50 ELSE steady_p50 END, 5), NULL, round(CASE current_phase WHEN 'low' THEN low_weight WHEN 'high' THEN high_weight WHEN 'steady' THEN steady_weight END, 6), NULL FROM learned""")
def p7_mode_learning(spark, sf):
    """Observation frame (medians, nearest other reading, switch state) to modes, their profiles, regimes, increments while busy, and phases."""
    from .composed import stacked

    e = events(spark, sf).withColumn("key", F.col("user_id"))
    of = lambda t, v: e.where(F.col("event_type") == t).select("key", F.col("ts").alias("time"), v.cast("double").alias("v"))
    f = e.where("event_type = 'click'").groupBy("key", bucket("ts", 15).alias("time")).agg(F.median("value").alias("load"))
    f = so.asof(f, of("signup", F.col("value") > 20), "key", "time", "v", how="backward").withColumn("on", F.coalesce(F.col("v_match") > 0, F.lit(False))).drop("v_match", "match_us")
    f = so.asof(f, of("view", F.col("value")), "key", "time", "v", 6 * HOUR)
    mode = F.when(F.col("on") & (F.col("load") >= 15), "active").when(F.col("on"), "standby").otherwise("off")
    f = scratch.table(f.select("key", "time", "load", mode.alias("mode"), F.coalesce(F.col("v_match") > 15, F.lit(False)).alias("busy")), "frame")
    q = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    three = lambda c: [R(F.col(c)[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))]
    runs = so.islands(f, "key", "time", "mode", 24 * HOUR)
    m = runs.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key", "run").alias("episodes"), F.percentile("load", q).alias("q"))
    grade = F.when((F.col("n") >= 30) & (F.col("episodes") >= 5), "mature").when(F.col("n") >= 8, "learning").otherwise("sparse")
    modes = m.select(F.lit("mode").alias("section"), "mode", "n", "episodes", *three("q"), grade.alias("grade"))
    split = learn.regimes(f.select("mode", "load"), "mode", "load").select(F.lit("regime").alias("section"), "mode", F.col("regime").cast("string").alias("part"), "n", R("location").alias("p50"), R("weight").alias("weight"))
    base = f.where("NOT busy").groupBy("mode").agg(F.median("load").alias("p50"))
    more = learn.increment_profile(f, base, f.where("busy").select("mode").distinct(), "key", "time", "mode", "load", "busy", gap_us=24 * HOUR).select(F.lit("increment").alias("section"), "mode", "n", "episodes", *[R(c).alias(c) for c in ("p10", "p50", "p90")])
    d = phases.phase_learning(f, "key", "time", "load", "mode", gap_factor=8, limit_minutes=17280, least=5)
    at = lambda c: F.when(F.col("current_phase") == "low", F.col(f"low_{c}")).when(F.col("current_phase") == "high", F.col(f"high_{c}")).when(F.col("current_phase") == "steady", F.col(f"steady_{c}"))
    told = d.select(F.lit("phase").alias("section"), "mode", "key", F.col("current_phase").alias("part"), F.col("samples").alias("n"), "episodes", R(F.coalesce(at("p50"), F.col("startup_p50")), 5).alias("p50"), R(at("weight")).alias("weight"))
    return stacked([modes, split, more, told]).select("section", "mode", "key", "part", "n", "episodes", "p10", "p50", "p90", "weight", "grade")
