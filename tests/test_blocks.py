"""Block operators and quantiles against plain recomputations, with block ends in the midst of runs, windows and ties."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, gaps, quantiles

MINUTE = 60_000_000
START = dt.datetime(2024, 3, 1)


def series(spark, seed, n=400, keys=("a", "b", None)):
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += r.choice([1, 1, 2, 5, 45])
        rows.append((r.choices(keys, [5, 1, 1])[0], START + dt.timedelta(minutes=t - 300), r.choice(["x", "x", "x", "y", None]), r.choice([None, 1.5, -2.0, 1e3, float(i)]), i))
    return rows, spark.createDataFrame(rows, "key string, time timestamp_ntz, label string, v double, i int").repartition(3)


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[1]) for k, v in out.items()}


@pytest.mark.parametrize("seed, block", [(1, 7 * MINUTE), (2, 60 * MINUTE), (3, 10_000 * MINUTE)])
def test_runs_numbers_and_sums(spark, seed, block):
    rows, df = series(spark, seed)
    gap = 30
    runs = {x.i: x.run for x in blocks.runs(df, "key", "time", "label", gap * MINUTE, block).collect()}
    places = {x.i: (x._i, x._n) for x in blocks.numbered(df, "key", "time", block_us=block).collect()}
    sums = {x.i: x.s for x in blocks.running_sum(df, "key", "time", F.col("i"), "s", block_us=block).collect()}
    prev = {x.i: x._before for x in blocks.before(df, "key", "time", ["label", "i"], block).collect()}
    assert len(runs) == len(places) == len(sums) == len(prev) == len(rows)
    for own in by_key(rows).values():
        run, total = 0, 0
        for k, r in enumerate(own):
            last = own[k - 1] if k else None
            run += last is None or last[2] != r[2] or (r[1] - last[1]).total_seconds() / 60 > gap
            total += r[4]
            assert (runs[r[4]], places[r[4]], sums[r[4]]) == (run, (k, len(own)), total)
            assert (prev[r[4]] is None) == (last is None) and (last is None or (prev[r[4]].label, prev[r[4]].i) == (last[2], last[4]))


@pytest.mark.parametrize("seed, block, back, ahead", [(1, 1, 15, 15), (2, 60 * MINUTE, 7, 30), (3, 10_000 * MINUTE, 500, 0)])
def test_rolling(spark, seed, block, back, ahead):
    rows, df = series(spark, seed)
    odd = {40: float("nan"), 90: float("inf"), 91: float("-inf"), 200: float("inf")}
    rows = [(*r[:3], odd.get(r[4], r[3]), r[4]) for r in rows]
    df = spark.createDataFrame(rows, df.schema).repartition(3)
    got = {x.i: (x._sum, x._count) for x in blocks.rolling(df, "key", "time", "v", back * MINUTE, ahead * MINUTE, block).collect()}
    assert len(got) == len(rows)
    for own in by_key(rows).values():
        for r in own:
            seen = [x[3] for x in own if x[3] is not None and dt.timedelta(minutes=-back) < x[1] - r[1] <= dt.timedelta(minutes=ahead)]
            total = sum(seen)
            assert got[r[4]][1] == len(seen) and (math.isclose(got[r[4]][0], total, abs_tol=1e-9) or math.isnan(total) and math.isnan(got[r[4]][0]))


def test_rolling_is_linear(spark):
    """80,000 rows at 20 a second and a window of half an hour: half of a day's rows in each window."""
    df = spark.range(80_000).select(F.lit(1).alias("key"), F.timestamp_micros(F.col("id") * 50_000).cast("timestamp_ntz").alias("time"), (F.col("id") % 7).cast("double").alias("v"))
    x = blocks.rolling(df, "key", "time", "v", 900_000_000, 900_000_000).agg(F.sum("_count").alias("n"), F.max("_count").alias("most")).first()
    assert x.most == 36_000 and x.n > 80_000 * 18_000


def same(got, want):
    assert len(got) == len(want)
    for k, (n, q) in want.items():
        assert got[k][0] == n and (got[k][1] == q or all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got[k][1], q, strict=True))), (k, got[k], q)


@pytest.mark.parametrize("seed, few", [(1, 3), (2, 40), (3, 10_000)])
def test_quantiles_are_percentile(spark, seed, few):
    r = random.Random(seed)
    kinds = {"a": lambda: r.gauss(0, 1), "b": lambda: float(r.randrange(4)), "c": lambda: r.choice([0.0, -0.0, 1e300, -1e300, float("nan"), None]), None: lambda: r.choice([5.0, 5.0, r.random()]), "d": lambda: 10.0 ** r.uniform(-300, 300), "e": lambda: None, "f": lambda: 7.0}
    rows = [(k, make()) for k, make in kinds.items() for _ in range(r.choice([1500, 1777]))] + [("g", 1.0), ("h", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    plain = {x.k: (x.n, x.q) for x in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile(F.col("v") + 0.0, F.array(*[F.lit(s) for s in shares])).alias("q")).collect()}
    got = {x.k: (x.n, x.q) for x in quantiles.quantiles(df, ["k"], "v", shares, small=100, few=few).collect()}
    same(got, plain)
    same({x.k: (x.n, x.q) for x in quantiles.quantiles(df, ["k"], "v", shares).collect()}, plain)
    whole = quantiles.quantiles(df, [], "v", [0.5], small=10, few=few).first()
    want = df.agg(F.count("v").alias("n"), F.percentile(F.col("v") + 0.0, F.array(F.lit(0.5))).alias("q")).first()
    assert (whole.n, whole.q) == (want.n, want.q)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert quantiles.quantiles(df, ["k"], "v", [0.5]).collect() == []


@pytest.mark.parametrize("seed, log", [(1, False), (2, True), (3, False)])
def test_widest_gap_is_the_sorts(spark, seed, log):
    r = random.Random(seed)
    kinds = {"a": lambda: r.random() * 100, "b": lambda: float(r.randrange(6) * 2), "c": lambda: 10.0 ** r.uniform(-3, 9), "d": lambda: 3.0, "e": lambda: r.choice([1.0, 2.0, 3.0, None, float("nan")])}
    rows = [(k, make()) for k, make in kinds.items() for _ in range(9000 if k == "a" else 400)] + [("one", 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {x.k: (x.n, x.low, x.high, x.gap) for x in gaps.widest_gap(df, ["k"], "v", F.log1p if log else lambda c: c).collect()}
    for k in kinds:
        vs = sorted(v for kk, v in rows if kk == k and v is not None and not math.isnan(v))
        f = math.log1p if log else (lambda x: x)
        gap, low, high = max(((f(b) - f(a), a, b) for a, b in zip(vs, vs[1:], strict=False)), key=lambda x: (x[0], -x[1]))
        assert got[k][:1] == (len(vs),) and math.isclose(got[k][3], gap, abs_tol=1e-12) and (log and gap < 1e-9 or got[k][1:3] == (low, high) or math.isclose(f(got[k][2]) - f(got[k][1]), gap, rel_tol=1e-9)), k
    assert got["one"][1:] == (None, None, None) and "none" not in got


@pytest.mark.parametrize("small, few", [(10, 5), (10, 10_000), (100_000, 5)])
def test_weighted_quantiles_are_those_of_repeated_rows(spark, small, few):
    r = random.Random(4)
    rows = [(k, r.choice([None, float("nan"), r.gauss(0, 9), 2.0]), r.randrange(1, 9)) for k in ("a", "b") for _ in range(300)] + [("c", None, 3)]
    df = spark.createDataFrame(rows, "k string, v double, w int").repartition(3)
    at = lambda d, **w: {x.k: (x.n, x.q) for x in quantiles.quantiles(d, ["k"], "v", [0.1, 0.5, 0.93], small=small, few=few, **w).collect()}
    same(at(df, weight="w"), at(df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("w"))))))
