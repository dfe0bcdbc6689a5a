"""Learning operators on constructed stations."""

from datetime import datetime, timedelta

import pytest

from tidemark.operators import ensemble, learn, phases

T0 = datetime(2024, 3, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_phases_of_a_station(spark):
    run = [470.0, 465.0] * 4 + [275.0, 278.0] * 6 + [455.0, 452.0] * 4 + [275.0, 278.0] * 6
    rows, i = [], 0
    for state, values in (("off", [230.0] * 8), ("kit", run), ("off", [230.0] * 8), ("kit", run)):
        for v in values:
            rows.append(("a", at(15 * i), v, state))
            i += 1
    rows += [("a", at(15 * i), None, "kit"), ("a", at(15 * i + 1), -5.0, "kit")]
    df = spark.createDataFrame(rows, "key string, time timestamp_ntz, v double, state string")
    got = {x.state: x for x in phases.phase_learning(df, "key", "time", "v", "state").collect()}
    kit, off = got["kit"], got["off"]
    assert 105 <= kit.startup_min_p50 <= 120 and kit.episodes == 2 and kit.changes == 6 and kit.current_phase == "low"
    assert 275 <= kit.low_p50 <= 278 and 452 <= kit.high_p50 <= 455 and 465 <= kit.startup_p50 <= 470 and kit.steady_p50 is None
    assert kit.low_weight == pytest.approx(0.75, abs=0.02) and kit.high_dwell == 120 and kit.samples == 80
    assert off.current_phase == "steady" and off.steady_p50 == 230 and off.startup_min_p50 == 0 and off.episodes == 2
    grid = spark.createDataFrame([("a", at(15 * i + k * 60)) for k in range(3)], "key string, time timestamp_ntz")
    path = phases.load_path(grid, phases.phase_learning(df, "key", "time", "v", "state").where("state = 'kit'"), "key", "time").collect()
    assert all(x.phase == "low" and x.p10 <= 276 and x.p90 >= 452 for x in path) and len(path) == 3


def test_short_runs_are_debounced(spark):
    for said, want in (("AABAA", "AAAAA"), ("BAACC", "AAACC"), ("AB", "AB"), ("BACDD", "AAADD"), ("AABB", "AABB"), ("AAB", "AAA")):
        df = spark.createDataFrame([("k", i, c) for i, c in enumerate(said)], "key string, time int, label string")
        assert "".join(x.label for x in phases.debounced(df, ["key"], "time", "label").orderBy("time").collect()) == want


def test_battery_parameters(spark):
    soc, rows = 40.0, []
    for i in range(24):
        up = i % 12 < 6
        rows.append(("b", at(30 * i), soc, 2000.0 if up else -1500.0, 100.0))
        nxt = 2000.0 if (i + 1) % 12 < 6 else -1500.0
        mean = ((2000.0 if up else -1500.0) + nxt) / 2
        soc += mean * 0.5 / 1000 * (0.92 if mean > 0 else 1 / 0.92) / 24.0 * 100
    df = spark.createDataFrame(rows + [("empty", at(0), None, None, None)], "key string, time timestamp_ntz, soc double, w double, load double")
    got = {x.key: x for x in learn.battery_model(df, "key", "time", "soc", "w", "load").collect()}
    b = got["b"]
    assert b.capacity == pytest.approx(24, abs=0.01) and b.charge_efficiency == pytest.approx(0.92, abs=0.01) and b.discharge_efficiency == pytest.approx(0.92, abs=0.01)
    assert b.max_charge == pytest.approx(2200) and b.max_discharge == pytest.approx(1650) and b.confidence == "calibrated"
    e = got["empty"]
    assert (e.n, e.capacity, e.max_charge, e.confidence) == (0, 26.0, 3000.0, "default")


def test_thresholds_and_registries(spark):
    df = spark.createDataFrame([("two", float(v)) for v in [10, 11, 12, 13] * 5 + [200, 201, 202] * 5] + [("one", float(v)) for v in range(100, 130)] + [("few", 1.0), ("few", 900.0)], "key string, v double")
    got = {x.key: x.threshold for x in learn.log_gap_threshold(df, "key", "v").collect()}
    assert 13 < got["two"] < 200 and got["one"] is None and got["few"] is None
    seen = spark.createDataFrame([("m", at(m), float(m)) for m in (0, 10, 20, 90, 200, 205)], "key string, time timestamp_ntz, v double")
    x = learn.spaced_registry(seen, "key", "time", "v", 60 * 60_000_000, keep=2).first()
    assert (x.n, x.level, x.latest) == (2, (90 + 205) / 2, 205.0)  # 0 and 10 gave way to 20, 200 to 205


def test_continuation(spark):
    paths = {"stays": [96.0, 97, 95], "dips": [96.0, 60, 97], "falls": [96.0, 30, 97], "down": [96.0, 60, 70], "low": [50.0, 60, 95], "one": [99.0], "null": [99.0, None, 99]}
    df = spark.createDataFrame([(k, at(60 * i), v) for k, p in paths.items() for i, v in enumerate(map(lambda x: None if x is None else float(x), p))], "key string, time timestamp_ntz, v double")
    got = {x.key: x for x in learn.continuation(df, "key", "time", "v").collect()}
    assert {k: x.reason for k, x in got.items()} == {"stays": "stays", "dips": "recovers", "falls": "breaches_minimum", "down": "does_not_recover", "low": "recovers", "one": "insufficient_forecast", "null": "insufficient_forecast"}
    assert got["dips"].recovery_time == at(120) and got["dips"].low == 60 and got["down"].recovery_time is None and got["stays"].recovery_time == at(120)


def test_projection_and_extension(spark):
    df = spark.createDataFrame([("sq", at(10 * i), 50 + 0.001 * (10 * i - 100) ** 2) for i in range(11)] + [("two", at(0), 10.0), ("two", at(60), 20.0), ("one", at(0), 1.0)], "key string, time timestamp_ntz, v double")
    got = {(x.key, x.ahead): x.projected for x in learn.projection(df, "key", "time", "v", 1440, 2, (0, 60)).collect()}
    assert got[("sq", 60.0)] == pytest.approx(53.6) and got[("two", 60.0)] == pytest.approx(30) and ("one", 0.0) not in got
    day = spark.createDataFrame([("s", at(60 * h), float(h % 24) - 5) for h in range(30)], "key string, time timestamp_ntz, v double")
    ends = spark.createDataFrame([("s", at(60 * 32 + 30))], "key string, horizon timestamp_ntz")
    got = {x.time: x.v for x in learn.diurnal_extension(day, "key", "time", "v", ends).collect()}
    assert got == {at(60 * 30): 1.0, at(60 * 31): 2.0, at(60 * 32): 3.0, at(60 * 32 + 30): 3.5}


def test_tail_extension_keeps_all_rows(spark):
    rows = [(1, lead, 1.5 * c, c) for lead, c in ((3, 10.0), (12, 20.0), (60, 30.0))] + [(2, 60, 7.0, 30.0), (2, 3, 0.4, 0.5)]
    got = {(x.m, x.lead): x.v for x in ensemble.tail_extension(spark.createDataFrame(rows, "m int, lead int, v double, c double"), ["m"], "lead", "v", "c").collect()}
    assert got[(1, 3)] == 15 and got[(1, 60)] == pytest.approx(30 * (1 + 0.5 * 1.5)) and got[(2, 60)] == 30 and len(got) == 5


def test_regimes_of_a_large_group(spark):
    """A group beyond the quantiles' bound for one task: the split of plain sorting."""
    from pyspark.sql import functions as F

    n = 130_000
    v = F.when(F.col("id") % 3 == 0, 900 + F.col("id") % 40).otherwise(100 + F.col("id") % 25).cast("double")
    df = spark.range(n).select(F.lit("a").alias("k"), v.alias("v")).union(spark.createDataFrame([("a", float("nan")), ("a", None)], "k string, v double"))
    got = {x.regime: x for x in learn.regimes(df, "k", "v").collect()}
    low = sorted(100.0 + i % 25 for i in range(n) if i % 3)
    high = sorted(900.0 + i % 40 for i in range(n) if i % 3 == 0)
    middle = lambda s: (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
    assert set(got) == {0, 1}
    for i, side in enumerate((low, high)):
        loc = middle(side)
        assert got[i].n == len(side) and got[i].location == loc and got[i].weight == pytest.approx(len(side) / n)
        assert got[i].scale == pytest.approx(max(3.0, 1.4826 * middle(sorted(abs(x - loc) for x in side))))
