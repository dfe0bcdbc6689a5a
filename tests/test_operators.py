"""Operators on constructed series: gaps, ties, nulls, bounds and invariants."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as fx
from tidemark.functions.times import HOUR, MINUTE, micros
from tidemark.operators import clean, series, stats
from tidemark.sources import files
from tidemark.streaming import streams

T0 = datetime(2024, 3, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def frame(spark, rows, schema="key string, time timestamp_ntz, v double"):
    return spark.createDataFrame(rows, schema)


def line(spark, minutes, values, key="a"):
    return frame(spark, [(key, at(m), v) for m, v in zip(minutes, values)])


def test_numbers_and_empty_columns(spark):
    df = spark.createDataFrame([("1.5", "x"), ("NAN", None), ("inf", ""), ("-2", "y")], "a string, b string")
    out = clean.drop_empty_columns(df.select(clean.to_number(F.col("a")).alias("a"), clean.to_number(F.col("b")).alias("b")))
    assert out.columns == ["a"] and [r.a for r in out.collect()] == [1.5, None, None, -2.0]


def test_cutoffs_and_slices(spark):
    df = line(spark, range(0, 600, 60), [1.0] * 10)
    assert clean.since(df, "time", ["2024-03-01T01:00:00Z", "2024-03-01T04:00:00+01:00"]).count() == 7
    assert clean.since(df, "time", []).count() == 10
    assert clean.window_slice(df, "time", "2024-03-01 01:00:00", "2024-03-01 03:00:00").count() == 3
    assert clean.window_slice(df, "time", "2024-03-01 03:00:00", "2024-03-01 03:00:00").count() == 0


def test_future_guard_falls_back(spark):
    df = line(spark, [0, 60 * 24 * 900], [1.0, 2.0])
    assert clean.drop_bogus_future(df, "time", "2024-03-02 00:00:00").count() == 1
    assert clean.drop_bogus_future(df, "time", "2020-01-01 00:00:00").count() == 2


def test_dedupe_is_idempotent(spark):
    df = frame(spark, [("a", at(0), 1.0), ("a", at(0), 2.0), ("b", at(0), 3.0)])
    once = clean.first_per_key(df, ["key", "time"], [F.desc("v")])
    assert sorted(r.v for r in once.collect()) == [2.0, 3.0]
    assert sorted(clean.first_per_key(once, ["key", "time"], [F.desc("v")]).collect()) == sorted(once.collect())


def test_counter_resets_and_nulls(spark):
    df = line(spark, [0, 1, 2, 3, 4, 24 * 60], [10.0, None, 13.0, 2.0, 5.0, 9.0])
    assert [r.total for r in series.counter_delta(df, "key", "time", "v").orderBy("time").collect()] == [0, None, 3, 3, 6, 0]


def test_energy_of_a_constant(spark):
    df = line(spark, range(0, 24 * 60 + 1, 30), [500.0] * 49)
    got = [r.kwh for r in series.trapezoid_energy(df, "key", "time", F.col("v")).orderBy("time").collect()]
    assert got[47] == pytest.approx(11.75) and got[48] == 0


def test_gap_markers(spark):
    df = line(spark, [0, 1, 2, 3, 20, 21, 22], [1.0] * 7)
    got = sorted(r.time_us for r in series.gap_markers(df, "key", "time").collect())
    start = line(spark, [3, 20], [0.0, 0.0]).select(micros("time").alias("t")).collect()
    assert got == [start[0].t + MINUTE, start[1].t - MINUTE]
    assert [r.segment for r in series.segments(df, "key", "time").orderBy("time").collect()] == [0, 0, 0, 0, 1, 1, 1]


def test_rolling_window_is_open_on_the_left(spark):
    df = line(spark, [0, 15, 30], [1.0, 2.0, 4.0])
    assert [r["mean"] for r in series.rolling_mean(df, "key", "time", "v").orderBy("time").collect()] == [1.5, 3.0, 4.0]


def test_asof_ties_and_tolerance(spark):
    probe = frame(spark, [("a", at(5), 0.0), ("a", at(100), 0.0), ("b", at(5), 0.0), ("a", at(30), 0.0)]).drop("v")
    sample = frame(spark, [("a", at(0), 1.0), ("a", at(10), 2.0), ("a", at(40), None), ("a", at(20), 3.0)])
    got = {(r.key, r.time): r.v_match for r in series.asof(probe, sample, "key", "time", "v", 10 * MINUTE).collect()}
    assert got == {("a", at(5)): 2.0, ("a", at(100)): None, ("b", at(5)): None, ("a", at(30)): 3.0}
    back = {r.time: r.v_match for r in series.asof(probe, sample, "key", "time", "v", how="backward").where("key = 'a'").collect()}
    assert back == {at(5): 1.0, at(100): 3.0, at(30): 3.0}


def test_interpolation(spark):
    grid = frame(spark, [("a", at(m), 0.0) for m in (-5, 0, 5, 10, 15)]).drop("v")
    got = [r.v for r in series.interpolate(grid, line(spark, [0, 10], [1.0, 3.0]), "key", "time", "v").orderBy("time").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_downsampling_keeps_spike_dip_and_ends(spark):
    r = random.Random(1)
    v = [r.random() for _ in range(500)]
    v[123], v[321] = 99.0, -99.0
    got = [x.v for x in series.downsample(line(spark, range(500), v), "key", "time", "v", 40).orderBy("time").collect()]
    assert len(got) <= 40 and {99.0, -99.0, v[0], v[-1]} <= set(got)
    assert series.downsample(line(spark, range(5), v), "key", "time", "v", 40).count() == 5


def test_bounded_balance_by_block_equals_fold(spark):
    r = random.Random(2)
    d = [r.uniform(-30, 30) if r.random() > 0.1 else None for _ in range(400)]
    df = line(spark, range(0, 400 * 30, 30), d)
    x, want = 50.0, []
    for y in d:
        x = min(100.0, max(0.0, x + (y or 0.0)))
        want.append(x)
    for out in (series.bounded_balance(df, "key", "time", "v", 50.0), series.balance_by_block(df, "key", "time", "v", F.to_date("time"), 50.0)):
        got = [r.balance for r in out.orderBy("time").collect()]
        assert got == pytest.approx(want, abs=1e-9) and min(got) >= 0 and max(got) <= 100


def test_islands_with_gaps_and_nulls(spark):
    df = spark.createDataFrame([("a", at(m), l) for m, l in ((0, "x"), (1, "x"), (2, None), (3, None), (4, "x"), (90, "x"))], "key string, time timestamp_ntz, l string")
    assert [r.run for r in series.islands(df, "key", "time", "l", HOUR).orderBy("time").collect()] == [1, 1, 2, 2, 3, 4]


def test_spread_duplicates(spark):
    df = spark.createDataFrame([("a", at(0), 0), ("a", at(0), 1), ("a", at(1), 2), ("b", at(0), 0), ("b", at(0), 1)], "key string, time timestamp_ntz, seq int")
    got = clean.spread_duplicates(df, "key", "time", "seq").select("key", "seq", (F.col("time_us") - micros(F.lit(str(T0)).cast("timestamp_ntz"))).alias("d")).collect()
    assert {(r.key, r.seq): r.d for r in got} == {("a", 0): 0, ("a", 1): 1_000_000, ("a", 2): MINUTE, ("b", 0): 0, ("b", 1): 500_000}


def test_crps_against_all_pairs(spark):
    x, y = [1.0, 4.0, 2.5, 7.0], 3.0
    want = sum(abs(a - y) for a in x) / 4 - sum(abs(a - b) for a in x for b in x) / 32
    df = spark.createDataFrame([(x, y), ([1.0], y)], "x array<double>, y double")
    got = [r[0] for r in df.select(stats.crps(F.col("x"), F.col("y"))).collect()]
    assert got[0] == pytest.approx(want) and got[1] is None


def test_levels(spark):
    df = spark.createDataFrame([("a", "gray"), ("a", "green"), ("b", "gray"), ("c", "red"), ("c", "amber")], "k string, l string")
    assert {r.k: r.w for r in df.groupBy("k").agg(stats.worst(F.col("l")).alias("w")).collect()} == {"a": "green", "b": "gray", "c": "red"}


def test_scalars(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    assert f(fx.dew_point(F.lit(20.0), F.lit(100.0))) == pytest.approx(20.0)
    assert f(fx.dew_point(F.lit(20.0), F.lit(0.0))) is None
    assert f(fx.wind(F.lit(0.0), F.lit(-5.0))[1]) == 0.0 and f(fx.wind(F.lit(-3.0), F.lit(0.0))[1]) == 90.0
    assert f(fx.haversine_km(F.lit(10.0), F.lit(179.9), F.lit(10.0), F.lit(-179.9))) < 25
    assert f(fx.mode_label(F.lit(5), ["a", "b", "c"])) == "a+c" and f(fx.mode_label(F.lit(0), ["a"])) == "idle"
    assert f(fx.quantile_at(F.lit(0.3), F.lit(0.0), F.lit(10.0), F.lit(20.0))) == pytest.approx(5.0)


def test_logger_and_csv_sources(spark, tmp_path):
    (tmp_path / "l.dat").write_text('"TOA5","x"\n"TIMESTAMP","t","u"\n"TS","C",""\n"","Avg",""\n"2024-03-01 00:00:00",1.5,"NAN"\n"2024-03-01 00:01:00","NAN",2\nbad,3,3\n')
    got = files.logger_table(spark, str(tmp_path / "l.dat"), ["t", "u"]).orderBy("time").collect()
    assert [(r.t, r.u) for r in got] == [(1.5, None), (None, 2.0)]
    (tmp_path / "p.csv").write_text("time,Battery SOC,wind dir,on,empty,uptime\n2024-03-01 00:00:00,50,9,True,,1\nx,1,1,false,,1\n2024-03-01 00:01:00,n/a,9,false,,1\n")
    p = files.wide_csv(spark, str(tmp_path / "p.csv"), "time")
    assert p.columns == ["time", "Battery_SOC", "on"] and [tuple(r)[1:] for r in p.orderBy("time").collect()] == [(50.0, 1.0), (None, 0.0)]


def test_tier_log(spark, tmp_path):
    (tmp_path / "t.log").write_text("2026-07-08 13:40:22: Tier change 4 3\n\n2026-07-08 13:41:22: Tier change 3 4\nTier?\n")
    rows, bad = files.tier_log(spark, str(tmp_path / "t.log"))
    assert [(r.before, r.after) for r in rows.orderBy("time").collect()] == [(4, 3), (3, 4)] and bad.count() == 1


def test_json_lines_and_readability(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "o.jsonl"), "a long").collect()) == [1, 2]
    for name, data in (("ok", b"\x89HDF\r\n\x1a\nrest"), ("odd", b"hello world")):
        (tmp_path / f"{name}.nc").write_bytes(data)
    f = spark.read.format("binaryFile").load(str(tmp_path / "*.nc")).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "length", F.substring("content", 1, 8).alias("head"))
    f = f.union(spark.createDataFrame([("zero.nc", 0, None)], "path string, length long, head binary"))
    got = {r.path: r.reason for r in files.readable(f, [b"\x89HDF\r\n\x1a\n"]).collect()}
    assert got == {"ok.nc": None, "zero.nc": "empty", "odd.nc": "unknown signature"}


def test_hold_back_stops_at_the_first_unsettled(spark):
    rows = [(f"f{i}", at(i), at(i + (100 if i == 2 else 0))) for i in range(5)]
    df = spark.createDataFrame(rows, "path string, time timestamp_ntz, modified timestamp_ntz")
    assert sorted(r.path for r in streams.held_back(df, "modified", str(at(60)), 600).collect()) == ["f0", "f1"]


def test_schema_policies(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, extra string, b double")
    assert streams.align_schema(df, {"a": "bigint", "c": "double"}).columns == ["a", "c"]
    assert streams.align_schema(df, {"a": "bigint"}, "expand", ("b",)).columns == ["a", "b"]
    with pytest.raises(ValueError):
        streams.align_schema(df, {"a": "bigint"}, "fail")


def test_alert_stream_holds_repeats_and_recovers(spark, tmp_path):
    rows = [(1, at(m), on) for m, on in ((0, True), (30, True), (70, True), (200, True), (70 + 721, True), (800, False), (900, True), (910, False))] + [(2, at(0), True), (2, at(10), False)]
    spark.createDataFrame(rows, "id long, ts timestamp, on boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    told = lambda path, folder: [(r.id, r.kind, r.ts) for r in streams.alert_states(streams.source(spark, str(tmp_path / path), "id long, ts timestamp, on boolean"), str(tmp_path / folder)).orderBy("ts").collect()]
    want = [(1, "alert", at(60)), (1, "alert", at(780)), (1, "recovery", at(800))]
    assert told("in", "one") == want
    # in two runs: the second goes on from the first's state; what is due by the newest event needs no further row of its id
    write = lambda some: spark.createDataFrame(some, "id long, ts timestamp, on boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
    write([r for r in rows if r[1] < at(40)] + [(3, at(59), False)])
    assert told("parts", "two") == []
    write([(3, at(75), False)])
    assert told("parts", "two") == want[:1] and told("parts", "two") == want[:1]
    write([r for r in rows if r[1] > at(40)] + [(1, at(5), False), (None, at(900), True)])  # one row is late, one has no id
    assert told("parts", "two") == want


def test_asof_and_interpolation_across_blocks(spark):
    import bisect

    r = random.Random(1)
    samples = sorted(r.sample(range(0, 60 * 24 * 12), 40))
    probes = sorted(r.sample(range(-5000, 60 * 24 * 14), 300))
    left = spark.createDataFrame([("k", at(m)) for m in probes], "key string, time timestamp").withColumn("time", F.col("time").cast("timestamp_ntz"))
    right = spark.createDataFrame([("k", at(m), float(m)) for m in samples] + [("k", at(1), None), ("other", at(3), 1.0)], "key string, time timestamp, v double").withColumn("time", F.col("time").cast("timestamp_ntz"))
    near = {x.time: x.v_match for x in series.asof(left, right, "key", "time", "v").collect()}
    back = {x.time: x.v_match for x in series.asof(left, right, "key", "time", "v", how="backward").collect()}
    line = {x.time: x.v for x in series.interpolate(left, right, "key", "time", "v").collect()}
    for m, (t, v) in zip(probes, sorted(near.items())):
        k = bisect.bisect_right(samples, m)
        assert v == min(samples, key=lambda s: (abs(s - m), -s))
        assert back[t] == (samples[k - 1] if k else None)
        assert line[t] == pytest.approx(min(max(m, samples[0]), samples[-1]))


def test_stream_equals_batch_after_a_second_run(spark, tmp_path):
    path, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    schema = "id long, ts timestamp"

    def run():
        s = streams.frontier_append(streams.source(spark, path, schema), "ts", ["id"], "30 days")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.schema(schema).parquet(out).collect())

    spark.createDataFrame([(i, at(i)) for i in range(10)], schema).write.parquet(path)
    assert run() == list(range(10))
    spark.createDataFrame([(i, at(i)) for i in range(5, 15)], schema).write.mode("append").parquet(path)
    assert run() == list(range(15)) and run() == list(range(15))
