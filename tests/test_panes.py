"""Trailing windows by panes against a plain recomputation, with issues again on the hour."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import panes

H = dt.timedelta(hours=1)
START = dt.datetime(2024, 5, 1)


def test_trailing_errors(spark):
    r = random.Random(3)
    rows = []
    for _ in range(500):
        valid = START + r.randrange(90) * H + dt.timedelta(minutes=r.choice([0, 0, 0, 1, 30, 59]))
        rows.append((r.randrange(2), r.choice([3, 12]), valid, START + dt.timedelta(seconds=r.randrange(10**6)), r.gauss(0, 5)))
    rows.append((9, 3, START + 300 * H, START, 4.0))
    df = spark.createDataFrame(rows, "cycle int, lead int, valid timestamp_ntz, issue timestamp_ntz, error double").repartition(4)
    got = {x.now: (x.n, round(x.mae, 9), round(x.bias, 9)) for x in panes.trailing_errors(df, "valid", ["cycle", "lead"], "issue", "error", 6).collect()}
    want = {}
    for k in range(-2, 320):
        now, best = START + k * H, {}
        for cycle, lead, valid, issue, error in rows:
            if now - 6 * H < valid <= now:
                hour = valid.replace(minute=0)
                best[cycle, lead, hour] = max(best.get((cycle, lead, hour), (issue, error)), (issue, error))
        if best:
            es = [e for _, e in best.values()]
            want[now] = (len(es), round(sum(map(abs, es)) / len(es), 9), round(sum(es) / len(es), 9))
    assert got == want


def test_trailing_counts(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), START + dt.timedelta(minutes=r.choice([r.randrange(3000), 60 * r.randrange(50)])), r.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, time timestamp_ntz, v double")
    got = {(x.k, x.now): (x.high, x.every) for x in panes.trailing_counts(df, "time", ["k"], {"high": F.col("v") > 0.5, "every": F.lit(True)}, 5).collect()}
    want = {}
    for k in "ab":
        for h in range(0, 60):
            seen = [v for x, t, v in rows if x == k and START + (h - 5) * H < t <= START + h * H]
            if seen:
                want[k, START + h * H] = (sum(v > 0.5 for v in seen), len(seen))
    assert {x: y for x, y in got.items() if y[1]} == want
