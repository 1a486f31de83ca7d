import json
import time

import pytest
from pyspark.sql import functions as F

from siftwork.streaming import sessions as s


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


EVENTS = [(1, 1, 1, "a"), (1, 2, 2, "b"), (1, 3, 1, "late"), (1, 4, 1, "cancelled"), (1, 5, 2, "c"), (2, 6, 5, "d"), (2, 7, 4, "late")]


def test_stale_in_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "chat_id long, seq long, generation long, kind string")
    want = [(1, 1), (1, 2), (1, 4), (1, 5), (2, 6)]
    assert rows(s.drop_stale(df), "chat_id", "seq") == want
    src = tmp_path / "in"
    for part in ("seq <= 3", "seq > 3"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with a timeout Spark goes on making batches without data
    q = s.drop_stale(stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = rows(spark.table("fresh"), "chat_id", "seq")
    assert {x for x in got if x[0] == 2} == {(2, 6)} and (1, 4) in got and (1, 2) in got


def test_throttle(spark):
    ticks = [(1, 0, "scan", 1, 9), (1, 30, "scan", 2, 9), (1, 60, "scan", 3, 9), (1, 61, "hash", 1, 9), (1, 62, "hash", 2, 9), (1, 63, "hash", 9, 9)]
    df = spark.createDataFrame(ticks, "run_id long, at long, phase string, done long, total long")
    assert [x[1] for x in rows(s.throttle_progress(df), "run_id", "at")] == [0, 60, 61, 63]


def test_idle_and_in_flight(spark):
    df = spark.createDataFrame([(1, 0), (1, 200), (1, 900), (2, 5)], "chat_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert rows(s.idle_sessions(df), "chat_id", "n") == [(1, 1), (1, 2), (2, 1)]
    req = spark.createDataFrame([(7, 3, "b"), (7, 1, "a"), (8, 2, "c")], "image_id long, ts long, who string")
    assert rows(s.drop_in_flight(req), "image_id", "who") == [(7, "a"), (8, "c")]


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "no")], "id long, body string")
    good, bad = s.split_bad(df, F.get_json_object("body", "$.a"))
    assert rows(good, "id") == [(1,)] and rows(bad, "id") == [(2,)]


def test_deliver_once(spark, tmp_path):
    sink = s.deliver_once(str(tmp_path / "out"), ["k"])
    one = spark.createDataFrame([(1,), (2,)], "k long")
    two = spark.createDataFrame([(2,), (3,)], "k long")
    sink(one, 0)
    sink(two, 1)
    sink(two, 1)  # run again
    assert rows(spark.read.parquet(str(tmp_path / "out")), "batch", "k") == [(0, 1), (0, 2), (1, 3)]


def test_resume_and_expiry(spark):
    runs = spark.createDataFrame([(1, "a", "active", 5), (1, "b", "waiting", 9), (2, "c", "done", 1)], "chat_id long, run_id string, status string, updated_at long")
    assert rows(s.resume(runs), "run_id", "action") == [("a", "cancel"), ("b", "resume")]
    assert rows(s.expired(runs, 8 * 86400), "run_id") == [("c",)]


def test_retries():
    waits, calls = [], []

    def send():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    assert s.with_retries(send, sleep=waits.append) == 3 and waits == [2.0, 4.0]
    calls.clear()
    with pytest.raises(OSError):
        s.with_retries(send, attempts=2, sleep=waits.append)
