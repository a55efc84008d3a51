"""Streaming operators against their batch results."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.streaming import events as E

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
T = dt.datetime(2024, 1, 1)


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps({"event_id": i, "ts": (T + dt.timedelta(seconds=s)).isoformat(), "user_id": u, "event_type": k, "value": 1.0}) for i, s, u, k in rows))


def test_admit():
    assert E.admit([0, 1, 2, 61, 62], [], 2, 60)[0] == [True, True, False, True, True]
    assert E.admit([0.0] * 5, [], 0, 60)[0] == [False] * 5


def test_windows_and_limit(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "a.json", [(1, 0, 1, "x"), (2, 10, 1, "x"), (3, 20, 1, "y"), (4, 30, 2, "x")])
    write(src, "b.json", [(5, 40, 1, "x"), (6, 70, 1, "x"), (7, 90000, 1, "x")])
    stream = lambda: E.file_stream(spark, str(src), SCHEMA, per_batch=1)
    q = E.to_memory(E.rate_limited(stream(), limit=2, seconds=60), "limited")
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, int((r.ts - T).total_seconds())): r.admitted for r in spark.sql("select * from limited").collect()}
    assert got == {(1, 0): True, (1, 10): True, (1, 20): False, (2, 30): True, (1, 40): False, (1, 70): True, (1, 90000): True}
    q = E.to_memory(E.tumbling(stream()), "days", "complete")
    q.processAllAvailable()
    q.stop()
    batch = spark.read.schema(SCHEMA).json(str(src)).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.sql("select event_type, n from days").collect()} == {(r.event_type, r.n) for r in batch.collect()}
    for name, df in (("hours", E.trailing_hour(stream())), ("visits", E.sessions(stream()))):
        q = E.to_memory(df, name, "complete")
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select sum(n) s from hours").first().s == 7 * 12
    assert spark.sql("select sum(n) s, count(*) c from visits").first().s == 7


def test_sinks(spark, tmp_path):
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    write(src, "a.json", [(1, 0, 1, "x"), (2, 10, 1, "x")])
    sink = E.upsert_sink(str(tmp_path / "t"), "event_id")
    E.run_new(E.file_stream(spark, str(src), SCHEMA), sink, ck)
    write(src, "b.json", [(2, 10, 9, "z"), (3, 10, 1, "x")])
    E.run_new(E.file_stream(spark, str(src), SCHEMA), sink, ck)
    E.run_new(E.file_stream(spark, str(src), SCHEMA), sink, ck)
    assert {(r.event_id, r.user_id) for r in E.upsert_table(spark, str(tmp_path / "t")).collect()} == {(1, 1), (2, 9), (3, 1)}
    late = spark.createDataFrame([(1, T, 5, "a", 2.0), (1, T, 6, "a", 1.0), (4, T, 1, "a", 1.0)], SCHEMA)
    E.upsert_sink(str(tmp_path / "t"), "event_id", "value")(late, 7)
    assert {(r.event_id, r.user_id) for r in E.upsert_table(spark, str(tmp_path / "t")).collect()} == {(1, 5), (2, 9), (3, 1), (4, 1)}
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name[0] == "v") == ["v1", "v7"]
    with pytest.raises(RuntimeError):
        E.upsert_sink(str(tmp_path / "elsewhere"), "event_id")(late, 3)
    fan = E.fan_out({"all": lambda b: b, "x": lambda b: b.where("event_type = 'x'")}, str(tmp_path / "f"))
    E.run_new(E.file_stream(spark, str(src), SCHEMA), fan, str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "f/all")).count() == 4 and spark.read.parquet(str(tmp_path / "f/x")).count() == 3
    done, rest, lost = E.retry_pending(spark.range(4), lambda df: df.withColumn("ok", F.when(F.col("id") == 0, None).otherwise(F.col("id") % 2 == 0)))
    assert [r.id for r in done.collect()] == [2] and {(r.id, r.attempts) for r in rest.collect()} == {(0, 1), (1, 1), (3, 1)} and lost.count() == 0


def test_admitted_batch(spark):
    rng = np.random.default_rng(3)
    rows = [(i, T + dt.timedelta(seconds=int(s)), int(u) if u < 5 else None) for i, (s, u) in enumerate(zip(rng.integers(0, 600, 800), rng.integers(0, 6, 800)))] + [(900, None, 1)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    want = {900: False}
    for user in {u for _, _, u in rows}:
        calls = sorted((t, i) for i, t, u in rows if u == user and t)
        kept = []
        for t, i in calls:
            kept = [k for k in kept if (t - k).total_seconds() < 60]
            want[i] = len(kept) < 4
            if want[i]:
                kept.append(t)
    got = {r.event_id: r.admitted for r in E.admitted(df, "user_id", "ts", "event_id", 4).collect()}
    assert got == want and len(set(got.values())) == 2 and E.admitted(df.limit(0), "user_id", "ts", "event_id").count() == 0
