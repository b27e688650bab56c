"""Debouncing by keyed state: once a burst, over restarts, as in batch."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arboria.plans import structures
from arboria.streaming import debounce, watch

RESTING = 10.0


def _wait(done, seconds=60):
    for _ in range(int(seconds / 0.25)):
        if done():
            return True
        time.sleep(0.25)
    return False


def _put(spark, folder, rows):
    spark.createDataFrame(rows, "rel string, mtime long").coalesce(1).write.mode("append").parquet(folder)


def test_a_burst_comes_once_over_a_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    _put(spark, src, [("a", 1)])
    time.sleep(1.1)
    _put(spark, src, [("a", 2), ("b", 5), ("a", 3)])

    def start():
        rows = spark.readStream.schema("rel string, mtime long").option("maxFilesPerTrigger", 1).parquet(src)
        return debounce.quieted(rows, RESTING).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="0.3 seconds").start()

    def came():
        try:
            return sorted(map(tuple, spark.read.schema("rel string, mtime long").parquet(out).collect()))
        except Exception:  # nothing written yet
            return []

    q = start()
    try:
        assert _wait(lambda: sum(p["numInputRows"] for p in q.recentProgress) == 4)
        assert came() == []
    finally:
        q.stop()
    q = start()  # what is pending comes from the checkpoint
    try:
        assert _wait(lambda: len(came()) >= 2)
        time.sleep(2)
        assert came() == [("a", 3), ("b", 5)]
    finally:
        q.stop()


@pytest.mark.parametrize("files", [1, 3])
def test_settled_is_as_in_batch(spark, tmp_path, files):
    base = 1_700_000_000
    events = [(k, base + 7 * i * (k + 1) % 900 + 2000 * (i // 9), i) for k in range(6) for i in range(60)]
    events = sorted(events, key=lambda e: (e[1] - base) // 2000) + [(0, base + 20_000, 0), (None, base + 1, 1)]
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in range(files):  # each file holds whole stretches of time, so none of its rows is late
        lo, hi = part * 20_000 // files, (part + 1) * 20_000 // files + (part == files - 1)
        some = [e for e in events if lo <= e[1] - base < hi]
        spark.createDataFrame(some, "k int, at long, i int").withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    rows = spark.readStream.schema("k int, at timestamp, i int").option("maxFilesPerTrigger", 1).parquet(src)
    q = debounce.settled(rows, "k", "at", 30).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(((r.k is None, r.k or 0), r.at) for r in spark.read.schema("k int, at timestamp").parquet(out).collect())
    every = spark.read.parquet(src).select("k", "at").distinct()
    most = every.agg(F.max("at")).first()[0]
    want = watch.debounced(every, "k", "at", 30).where(F.unix_micros("at") + 30_000_000 <= F.unix_micros(F.lit(most)))
    assert got == sorted(((r.k is None, r.k or 0), r.at) for r in want.collect()) and len(got) > 50


def test_a_watched_file_written_twice_is_ingested_once(spark, tmp_path):
    src, said = tmp_path / "src", []
    src.mkdir()
    q = watch.watch(spark, str(src), lambda paths: {"n": len(paths)}, str(tmp_path / "cp"), 0.3, said.append, quiet=3.0)
    try:
        time.sleep(1.5)
        for text in ("a = 1\n", "a = 2\n", "a = 3\n"):
            (src / "new.py").write_text(text)
            time.sleep(0.7)
        assert _wait(lambda: said)
        time.sleep(4)
        assert [x["paths"] for x in said] == [["new.py"]]
    finally:
        q.stop()


def _settled(spark, tmp_path, parts, seconds, **more):
    """(k, at in microseconds) that settled() gives of parts, each a file and a micro-batch; and the stream's progress."""
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for some in parts:
        spark.createDataFrame(some, "k long, us long").select("k", F.timestamp_micros("us").alias("at")).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    rows = spark.readStream.schema("k long, at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = debounce.settled(rows, "k", "at", seconds, **more).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((tuple(r) for r in spark.read.schema("k long, at timestamp").parquet(out).select("k", F.unix_micros("at")).collect()), key=str), q.recentProgress


def test_ends_of_bursts_take_no_timer_each(spark, tmp_path):
    base = 1_700_000_000_000_000
    events = [(k, base + i * 100_000_000 + k) for k in range(20) for i in range(60)]  # every event is an end
    got, progress = _settled(spark, tmp_path, [events], 30)
    assert got == sorted((e for e in events if e[1] < base + 59 * 100_000_000), key=str)
    assert 0 < sum(s["customMetrics"]["numRegisteredTimers"] for p in progress for s in p["stateOperators"]) <= 2 * 20


@pytest.mark.parametrize("before", [0, 1])
def test_what_the_watermark_equals_is_settled(spark, tmp_path, before):
    base = 1_700_000_000_000_000
    parts = [[(1, base + 999), (2, base + 30_000_000 - 1000 * before)], [(2, base + 30_000_000), (3, base + 30_000_001)]]
    got, _ = _settled(spark, tmp_path, parts[: before + 1], 30, buckets=1)
    assert got == [(1, base + 999)]


def test_changes_out_of_order_settle_as_in_batch(spark, tmp_path):
    draw, base, gap, late = random.Random(4), 1_700_000_000_000_000, 10, 60
    events = sorted({(draw.choice([None, *range(12)]), base + draw.randrange(600_000) * 1000) for _ in range(700)}, key=lambda e: e[1] + draw.randrange(late * 1_000_000))
    got, _ = _settled(spark, tmp_path, [events[n : n + 100] for n in range(0, len(events), 100)], gap, delay=f"{late} seconds", buckets=3)
    until, want = max(us for _, us in events) // 1000 - late * 1000, []
    for k in {k for k, _ in events}:
        own = sorted(us for x, us in events if x == k)
        want += [(k, a) for a, b in zip(own, [*own[1:], None]) if (b is None or b - a >= gap * 1_000_000) and a // 1000 + gap * 1000 <= until]
    assert got == sorted(want, key=str) and len(want) > 100


def test_events_without_user_or_time(spark, tmp_path):
    base = 1_700_000_000_000_000
    rows = [(1, base), (None, base + 1), (2, None), (1, base + 7_200_000_000), (2, base + 1_000_000), (None, base + 10_900_000_000), (None, None)]
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in structures.debounce_stream(spark, str(tmp_path)).select("user_id", F.unix_micros("ts")).collect())
    assert got == [(1, base), (1, base + 7_200_000_000), (2, base + 1_000_000)]


def test_a_key_of_many_rows_is_joined_by_steps():
    ats = np.random.default_rng(4).permutation(np.repeat(np.arange(30_000) * 40_000 // 3, 10))
    frames = [pd.DataFrame({"key_text": "=1", "at_us": ats[n : n + 10_000]}) for n in range(0, len(ats), 10_000)]
    taken = list(debounce._gathered(iter(frames), lambda: 25_000))
    assert [len(x) for x in taken] == [30_000] * 10
    spans = pd.DataFrame({"key_text": [], "first": [], "last": []}).astype({"first": "int64", "last": "int64"})
    for new in taken:
        spans = debounce._bursts(pd.concat([spans, pd.DataFrame({"key_text": new["key_text"], "first": new["at_us"], "last": new["at_us"]})]), 13_334)
    every = np.unique(ats)
    assert spans["last"].tolist() == every[np.append(np.diff(every) >= 13_334, True)].tolist()
