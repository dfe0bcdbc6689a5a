"""The merge store: replays, crashes between write and commit, columns by policy, pruning, streams."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.store import Store, followed
from tidemark.streaming.streams import source

SHAPE = "id long, seq long, v string"


def rows_of(spark, rows, shape=SHAPE):
    return spark.createDataFrame(rows, shape)


def found(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_merge_and_replay(spark, tmp_path):
    s = Store(spark, str(tmp_path), ["id"], "seq", buckets=4)
    assert s.read() is None
    assert s.merge(rows_of(spark, [(i, 1, "a") for i in range(20)] + [(3, 5, "late"), (None, 1, "n")]), 0)
    assert len(found_n := s.read().collect()) == 21 and {r.v for r in found_n if r.id == 3} == {"late"}
    touched = s.merge(rows_of(spark, [(3, 4, "older"), (7, 9, "new"), (100, 1, "b"), (None, 2, "m")]), 1)
    before = sorted(map(str, s.read().collect()))
    assert touched and len(touched) <= 4 and {r.v for r in s.read().where("id IN (3, 7, 100) OR id IS NULL").collect()} == {"late", "new", "b", "m"}
    assert s.merge(rows_of(spark, [(7, 99, "again")]), 1) == [] and sorted(map(str, s.read().collect())) == before
    assert s.merge(rows_of(spark, []), 2) == [] and sorted(map(str, s.read().collect())) == before


def test_only_touched_buckets_are_written(spark, tmp_path):
    s = Store(spark, str(tmp_path), ["id"], "seq", buckets=8)
    s.merge(rows_of(spark, [(i, 1, "a") for i in range(64)]), 0)
    assert len(s.merge(rows_of(spark, [(5, 2, "b")]), 1)) == 1
    m = s._manifest()
    assert sorted(m["buckets"].values()) == [1] * 7 + [2] and len(found(s)) == 64


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), ["id"], "seq", buckets=4)
    s.merge(rows_of(spark, [(1, 1, "a"), (2, 1, "a")]), 0)
    with monkeypatch.context() as broken:
        broken.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.merge(rows_of(spark, [(1, 2, "half"), (9, 1, "half")]), 1)
    assert found(s) == [(1, 1, "a"), (2, 1, "a")]
    s.merge(rows_of(spark, [(1, 2, "whole")]), 1)
    assert found(s) == [(1, 2, "whole"), (2, 1, "a")]


def test_second_writer_loses(spark, tmp_path):
    s = Store(spark, str(tmp_path), ["id"], "seq")
    s.merge(rows_of(spark, [(1, 1, "a")]), 0)
    with pytest.raises(RuntimeError):
        s._commit(s._manifest())


@pytest.mark.parametrize("policy, columns", [("drop", ["id", "seq", "v"]), ("expand", ["id", "seq", "v", "note"])])
def test_columns_by_policy(spark, tmp_path, policy, columns):
    s = Store(spark, str(tmp_path), ["id"], "seq", policy=policy, allowed=["note"])
    s.merge(rows_of(spark, [(1, 1, "a"), (2, 1, "a")]), 0)
    s.merge(spark.createDataFrame([(2, 2, "x", 7)], "id long, seq long, note string, other int"), 1)
    assert s.read().columns == columns
    got = {r.id: r for r in s.read().collect()}
    assert got[1].v == "a" and got[2].v is None and (policy == "drop" or (got[1].note, got[2].note) == (None, "x"))
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), ["id"], "seq", policy="fail").merge(spark.createDataFrame([(2, 3, 1)], "id long, seq long, strange int"), 2)


def test_prune(spark, tmp_path):
    s = Store(spark, str(tmp_path), ["id"], "seq", buckets=4)
    s.merge(rows_of(spark, [(i, i, "a") for i in range(12)]), 0)
    s.prune(F.col("seq") >= 9)
    assert [x[0] for x in found(s)] == [9, 10, 11]
    assert s.merge(rows_of(spark, [(1, 50, "b")]), 0) == [] and s.merge(rows_of(spark, [(1, 50, "b")]), 1)
    assert [x[0] for x in found(s)] == [1, 9, 10, 11]


def test_stream_in_two_runs_equals_one(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(3):
        rows_of(spark, [(i, k * 10 + i, f"f{k}") for i in range(k, 6)]).coalesce(1).write.mode("append").parquet(src)
        if k < 2:
            followed(source(spark, src, SHAPE, 1), ["id"], "seq", str(tmp_path / "two"))
    two = followed(source(spark, src, SHAPE, 1), ["id"], "seq", str(tmp_path / "two"))
    one = followed(source(spark, src, SHAPE), ["id"], "seq", str(tmp_path / "one"))
    assert found(two) == found(one) and len(found(one)) == 6


def test_publishing_in_batches_equals_one_run(spark, tmp_path):
    import datetime as dt

    from tidemark.streaming.publish import publish_changes

    shape = "id long, t timestamp, level double, kind string"
    start, src = dt.datetime(2024, 1, 1), str(tmp_path / "in")
    rows = [(i % 4, start + dt.timedelta(minutes=i), [1.0, 1.0, 1.0 + 1e-9, 2.0, None][(i * 7 // 5) % 5], "ab"[i // 9 % 2] if i % 6 else None) for i in range(120)]

    def run(at, per):
        return sorted((x.id, x.t, tuple(x.reasons)) for x in publish_changes(source(spark, src, shape, per), "id", "t", ["level", "kind"], str(tmp_path / at), buckets=3).collect())

    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], shape).coalesce(1).write.mode("append").parquet(src)
        three = run("three", 1)
    want, now = [], {}
    for i, t, level, kind in rows:
        old = now.setdefault(i, {})
        why = [n for n, v in (("level", level), ("kind", kind)) if v is not None and not (n in old and (abs(old[n] - v) <= 1e-6 if n == "level" else old[n] == v))]
        old.update({n: v for n, v in (("level", level), ("kind", kind)) if v is not None})
        if why:
            want.append((i, t, tuple(why)))
    assert three == run("one", None) == sorted(want)
