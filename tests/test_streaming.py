"""Streaming operators over small file streams."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.streaming import processors


def test_limit_holds_and_flushes():
    frame = pd.DataFrame({"t": [0, 3, 4, 30], "value": [1.0, 2.0, 3.0, 4.0]})
    out, state = processors._limit(frame, (None, None), None, 10)
    assert out == [(0, 1.0), (10, 3.0), (30, 4.0)] and state == (40, None)
    out, state = processors._limit(pd.DataFrame({"t": [31], "value": [5.0]}), state, None, 10)
    assert out == [] and state == (40, 5.0)
    assert processors._limit(pd.DataFrame({"t": [], "value": []}), state, 0, 10) == ([(40, 5.0)], (50, None))


@pytest.fixture
def folder(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1), ("2024-01-01 00:10:00", "a", 2), ("2024-01-01 02:00:00", "b", 3), ("2024-01-02 00:00:00", "a", 4)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "s string, k string, v long").selectExpr("to_timestamp(s) as ts", "k", "v").coalesce(1).write.parquet(path)
    return path


def test_sessions_and_sliding(spark, folder, tmp_path):
    stream = processors.event_stream(spark, folder, "ts timestamp, k string, v long")
    s = processors.drain(processors.sessions(stream, time="ts", gap="30 minutes", late="1 hour", keys=["k"]), "sessions", str(tmp_path / "c1"))
    assert {(r.k, r.n) for r in s.collect()} >= {("a", 2), ("b", 1)}
    w = processors.drain(processors.sliding(stream, time="ts", width="1 hour", step="30 minutes", late="1 hour", keys=["k"]), "sliding", str(tmp_path / "c2"))
    assert sum(r.n for r in w.collect() if r.k == "b") == 2


def test_first_seen(spark, folder, tmp_path):
    stream = processors.event_stream(spark, folder, "ts timestamp, k string, v long")
    out = processors.drain(processors.first_seen(stream.unionByName(stream), time="ts", late="2 days", keys=["v"]), "first", str(tmp_path / "c3"))
    assert sorted(r.v for r in out.collect()) == [1, 2, 3, 4]


def test_overlapping_files_lose_nothing(spark, tmp_path):
    """Two files whose times overlap, the later one first by name: run dedup, limiter and first-seen as over one ordered table."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=37 * i), "ab"[i % 3 == 0], float(i % 4)) for i in range(200)]
    path = str(tmp_path / "events")
    for name, part in (("late", rows[1::2]), ("early", rows[::2])):
        spark.createDataFrame(part, "id long, ts timestamp, key string, value double").coalesce(1).write.parquet(f"{path}/{name}")
    stream = processors.event_stream(spark, f"{path}/*", "id long, ts timestamp, key string, value double").withColumn("t", F.unix_micros("ts"))
    runs = processors.drain(processors.run_dedup(stream.select("key", "id", "t", F.col("value").cast("string").alias("value"))), "runs", str(tmp_path / "c1"))
    want = []
    for key in "ab":
        own = [r for r in rows if r[2] == key]
        want += [(key, r[0]) for k, r in enumerate(own) if not k or own[k - 1][3] != r[3]]
    assert sorted((r.key, r.id) for r in runs.collect()) == sorted(want)
    seen = processors.drain(processors.first_seen(stream.unionByName(stream), time="ts", late="1 hour", keys=["id"]).select("id"), "seen", str(tmp_path / "c2"))
    assert sorted(r.id for r in seen.collect()) == list(range(200))
    counts = processors.drain_complete(processors.tumbling(stream, time="ts", width="1 day", late="1 hour", keys=["key"], value="value"), str(tmp_path / "c3"))
    assert sum(r.n for r in counts.collect()) == 200
