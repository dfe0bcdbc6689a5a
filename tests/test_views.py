"""Grids, coverage, health and listings on small tables with nulls, gaps and nothing at all."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, coverage, grids, health, series
from tidemark.sources import listing

START = dt.datetime(2024, 2, 1)
H = dt.timedelta(hours=1)


@pytest.mark.parametrize("hours, height, quality, want", [(1, None, "full", (1, 1200, 200)), (6, 900, "full", (1, 800, 400)), (24, 3000, "full", (1, 400, 300)), (25, 3001, "full", (2, 300, 200)), (1, 500, "coarse", (2, 400, 200)), (None, None, "coarse", (2, 100, 100))])
def test_sampling_targets(hours, height, quality, want):
    assert grids.sampling_targets(hours, height, quality) == want


def test_coarsen_means_of_means(spark):
    cells = {(t, g): float(t * 10 + g) for t in range(7) for g in range(5) if (t, g) not in ((0, 0), (3, 1))}
    df = spark.createDataFrame([(START + t * H, float(g * 30), v) for (t, g), v in cells.items()], "time timestamp_ntz, gate double, v double").repartition(3)
    got = {(x.time, x.gate): x.v for x in grids.coarsen(df, "v", {"gate": 2, "time": 3}).collect()}
    want = {}
    for tb in range(2):
        for gb in range(2):
            means = []
            for t in range(3 * tb, 3 * tb + 3):
                vs = [cells[t, g] for g in (2 * gb, 2 * gb + 1) if (t, g) in cells]
                means += [sum(vs) / len(vs)] if vs else []
            want[START + (3 * tb + 1) * H, gb * 60 + 15.0] = pytest.approx(sum(means) / len(means))
    assert got == want
    assert grids.coarsen(df.limit(0), "v", most={"time": 2}).collect() == []
    assert {x.gate for x in grids.coarsen(df, "v", most={"gate": 2}).collect()} == {30.0}  # three gates a block, the rest goes


def test_window_view(spark):
    df = spark.createDataFrame([(START + k * dt.timedelta(seconds=30), float(g), 1.0) for k in range(300) for g in range(0, 1200, 100)], "time timestamp_ntz, gate double, v double")
    short = grids.window_view(df, "time", "gate", "v", "2024-02-01 00:00:00", "2024-02-01 01:00:00", 100.0, 900.0)
    assert short.count() == 121 * 9  # nothing to thin
    long = grids.window_view(df, "time", "gate", "v", "2024-02-01 00:00:00", "2024-02-04 00:00:00")
    assert long.select("time").distinct().count() == 150  # every second time
    assert grids.window_view(df, "time", "gate", "v", "2024-02-02 00:00:00", "2024-02-01 00:00:00").count() == 0


def test_coverage(spark):
    times = [0.2, 0.9, 3.0, 26.5, 47.99, 49.0]
    df = spark.createDataFrame([("a", START + t * H) for t in times] + [("b", START + 5 * H), ("b", None)], "k string, t timestamp_ntz")
    days = coverage.day_hours(df, "t", ["k"])
    assert {(x.k, x.day.day): x.hours for x in days.collect()} == {("a", 1): 1 | 8, ("a", 2): 1 << 2 | 1 << 23, ("a", 3): 2, ("b", 1): 32}
    twice = coverage.merged([days, days, coverage.day_hours(df.limit(0), "t", ["k"])], ["k"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, days.collect()))
    got = {x.k: (x.seen, x.missing, x.expected) for x in coverage.hour_coverage(days, ["k"], "2024-02-01 03:40:00", "2024-02-03 01:10:00").collect()}
    assert got == {"a": (4, 43, 47), "b": (1, 46, 47)}
    bits = {x.k: (x.bits, x.seen) for x in coverage.segment_bits(df, "t", ["k"], "2024-02-01 00:00:00", "2024-02-03 01:00:00", 49).collect()}
    assert bits == {"a": (1 | 1 << 3 | 1 << 26 | 1 << 47 | 1 << 48, 5), "b": (32, 1)}  # the window's end is in the last segment
    states = {(x.day.day, x.hour): x.state for x in coverage.hour_states(coverage.day_hours(df.union(spark.createDataFrame([("b", START + 3 * H)], df.schema)), "t", ["k"]), "k", ["a", "b"]).collect()}
    assert len(states) == 72 and (states[1, 3], states[1, 5], states[1, 4]) == (2, 1, 0)
    with pytest.raises(ValueError):
        coverage.segment_bits(df, "t", ["k"], "2024-02-02 00:00:00", "2024-02-01 00:00:00")


def test_health(spark):
    rows = [("s1", "source", "sync", True), ("s1", "service", "b", False), ("s1", "service", "a", False), ("s1", "service", "d", False), ("s1", "service", "c", False), ("s2", "source", "sync", False), ("s2", "service", "a", True), ("s3", "source", "sync", None), ("s3", "service", "a", None), ("s4", "source", "sync", None), ("s4", "service", "a", True)]
    streams = health.stream_health(spark.createDataFrame(rows, "stream string, role string, name string, ok boolean"))
    got = {x.stream: (x.level, x.healthy, x.services, x.failed, x.detail) for x in streams.collect()}
    assert got == {"s1": ("red", 0, 4, "a,b,c,d", "Unhealthy: a, b, c"), "s2": ("red", 1, 1, "", "Source is unhealthy"), "s3": ("unknown", 0, 1, "", "No current status"), "s4": ("green", 1, 1, "", "Source and services healthy")}
    assert {x.cause: (x.level, x.streams) for x in health.root_causes(streams).collect()} == {"source": ("red", 1), "processing": ("red", 1)}
    assert {x.level for x in health.root_causes(streams.limit(0)).collect()} == {"unknown"}


def test_only_fresh_switches_hold_back(spark):
    issues = spark.createDataFrame([(i,) for i in range(5)], "id long")
    now = START + 10 * H
    switches = spark.createDataFrame([(0, now - H, False), (1, now - 5 * H, False), (2, now - H, None), (3, now - H, True), (0, now - 2 * H, True)], "id long, t timestamp_ntz, on boolean")
    left = health.let_through(issues, switches, "id", "t", "on", F.lit(str(now)).cast("timestamp_ntz"), 2 * 3_600_000_000)
    assert sorted(x.id for x in left.collect()) == [1, 2, 3, 4]


def test_catalog(spark):
    rows = [("a", START + dt.timedelta(minutes=m), i, k) for i, (m, k) in enumerate([(5, "image"), (29, "image"), (31, "video"), (65, "image"), (90, "image")])] + [("b", START, 9, "image")]
    df = spark.createDataFrame(rows, "source string, t timestamp_ntz, id long, kind string")
    hours = catalog.representative_hours(df, "source", "t", "id")
    assert {(x.source, x.hour): x.id for x in hours.collect()} == {("a", 0): 1, ("a", 1): 4, ("b", 0): 9}
    assert {(x.hour, x.a, x.b) for x in catalog.hourly_pivot(hours, "source", "id", ["a", "b"]).collect()} == {(0, 1, 9), (1, 4, None)}
    assert {(x.source, x.n, x.hours, x.preferred) for x in catalog.preferred(df, "source", "t", "id", "kind").collect()} == {("a", 5, 2, 2), ("b", 1, 1, 9)}


def test_listing(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "twofold"), ("c.bin", "x")):
        (tmp_path / name).write_text(text)
    os.utime(tmp_path / "b.txt", (1_600_000_000, 1_600_000_000))
    old = spark.createDataFrame(listing.listing(spark, str(tmp_path), "*.txt").collect(), "path string, size long, modified timestamp_ntz")
    assert {(os.path.basename(x.path), x.size) for x in old.collect()} == {("a.txt", 3), ("b.txt", 7)}
    assert [bytes(x.head) for x in listing.listing(spark, str(tmp_path), "b.*", head=3).collect()] == [b"two"]
    assert [os.path.basename(x.path) for x in listing.listing(spark, str(tmp_path), modified_before="2021-01-01T00:00:00").collect()] == ["b.txt"]
    os.utime(tmp_path / "b.txt", (1_600_000_100, 1_600_000_100))
    (tmp_path / "d.txt").write_text("new")
    (tmp_path / "a.txt").unlink()
    now = listing.listing(spark, str(tmp_path), "*.txt")
    assert {os.path.basename(x.path) for x in listing.changed(now, old).collect()} == {"b.txt", "d.txt"}
    assert {os.path.basename(x.path) for x in listing.removed(now, old).collect()} == {"a.txt"}


def test_gapped_lines_stay_in_budget(spark):
    rows = [("k", START + (k * 10 + k // 4 * 600) * dt.timedelta(seconds=1), float(k * 7 % 13)) for k in range(200)] + [("one", START, 1.0), ("flat", START, 2.0), ("flat", START + H, 2.0)]
    df = spark.createDataFrame(rows, "key string, time timestamp_ntz, v double").repartition(3)
    for budget in (2, 3, 4, 7, 30, 1000):
        out = series.gapped(df, "key", "time", "v", budget).collect()
        own = [x for x in out if x.key == "k"]
        assert len(own) <= max(budget, 2) and sum(x.v is None for x in own) <= max(0, budget - 2)
        drawn = sorted(x.time_us for x in own if x.v is not None)
        ends = [int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for t in (rows[0][1], rows[199][1])]
        assert [drawn[0], drawn[-1]] == ends
