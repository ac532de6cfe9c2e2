"""Streams give the same result however ids in order are cut into files."""

import random
from dataclasses import replace
from datetime import datetime, timedelta
from statistics import mean

import pytest
from pyspark.sql import functions as F

from looplake.config import DEFAULT
from looplake.streaming import streams as STR


@pytest.mark.parametrize("files", [1, 3, 8])
def test_auto_trigger_starts_at_the_scope_state(spark, files):
    rows = [("a", k, k % 5 != 0, None) for k in range(1, 41)] + [("b", k, None, None) for k in range(41, 47)]
    feedback = spark.createDataFrame(rows, STR.FEEDBACK_EVENT_SCHEMA)
    start = spark.createDataFrame([("a", 10), ("c", 3)], "scope_key string, last_processed_feedback_id long")
    p = STR.scratch(spark, "trigger_test")
    STR.write_files(feedback, p["source"], files, "id")
    got = STR.auto_trigger_stream(spark, p["source"], p["sink"], p["checkpoint"], replace(DEFAULT, auto_batch_size=3), start=start)
    ids = {"a": [k for k in range(11, 41) if k % 5], "b": list(range(41, 47))}
    assert sorted((r.scope_key, r.batch_ids) for r in got.collect()) == sorted(
        (s, ",".join(map(str, x[i:i + 3]))) for s, x in ids.items() for i in range(0, len(x), 3))


def test_a_scope_in_cooldown_waits(spark):
    cfg = replace(DEFAULT, auto_batch_size=3)
    start = spark.createDataFrame([("a", 2, datetime(2024, 2, 1))], "scope_key string, last_processed_feedback_id long, cooldown_until timestamp")
    p = STR.scratch(spark, "trigger_cooldown")
    rows = [("a", k, True, None) for k in range(1, 10)] + [("b", k, True, None) for k in range(10, 14)]
    STR.write_files(spark.createDataFrame(rows, STR.FEEDBACK_EVENT_SCHEMA), p["source"], 2, "id")

    def run(now):
        out = STR.auto_trigger_stream(spark, p["source"], p["sink"], p["checkpoint"], cfg, start=start, now=now)
        return sorted((r.scope_key, r.batch_ids) for r in out.collect())

    assert run(F.lit(datetime(2024, 1, 31))) == [("b", "10,11,12")]
    more = spark.createDataFrame([("a", 14, True, None)], STR.FEEDBACK_EVENT_SCHEMA)
    more.coalesce(1).write.mode("append").parquet(p["source"])
    assert run(F.lit(datetime(2024, 2, 2))) == [("a", "3,4,5"), ("a", "6,7,8"), ("b", "10,11,12")]


def _events(spark, rows):
    return spark.createDataFrame([(i, c, "a", act, conf, 1.0, ts) for i, c, act, conf, ts in rows], STR.MONITOR_SCHEMA)


@pytest.mark.parametrize("files", [1, 3])
def test_hours_come_from_the_state_and_a_restart_goes_on(spark, files):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(k, "c", "a" if k % 3 else "b", None if k % 7 == 0 else k / 100, at(11 * k)) for k in range(60)]
    p = STR.scratch(spark, "hours")
    STR.write_files(_events(spark, rows[:40]), p["source"], files, "event_id")
    STR.hourly_metrics_stream(spark, p["source"], p["sink"], p["checkpoint"])
    STR.write_files(_events(spark, rows[40:]), p["source"], files, "event_id")
    out = STR.hourly_metrics_stream(spark, p["source"], p["sink"], p["checkpoint"])
    hours = {}
    for k, _, act, conf, ts in rows:
        hours.setdefault(ts.replace(minute=0), []).append((act == "a", conf))
    want = [(h, len(v), sum(ok for ok, _ in v) / len(v), mean(c for _, c in v if c is not None)) for h, v in hours.items()]
    got = sorted(out.select("window_start", "predictions", "accuracy", "avg_confidence").collect())
    assert [tuple(r[:2]) for r in got] == [w[:2] for w in want]
    assert [tuple(r[2:]) for r in got] == [pytest.approx(w[2:]) for w in want]
    again = STR.hourly_metrics_stream(spark, p["source"], p["sink"], p["checkpoint"])  # nothing new
    assert sorted(again.collect()) == sorted(out.collect())


def test_hours_of_an_empty_source(spark):
    p = STR.scratch(spark, "hours_empty")
    _events(spark, []).write.parquet(p["source"])
    assert STR.hourly_metrics_stream(spark, p["source"], p["sink"], p["checkpoint"]).collect() == []


@pytest.mark.parametrize("files", [1, 3, 8])
def test_error_bursts_of_a_hot_key_over_files_and_blocks(spark, files):
    rng = random.Random(5)
    rows = [(k, None if rng.random() < 0.8 else "c", rng.choice(["a", "b", "b", None]), 0.5, datetime(2024, 1, 1) + timedelta(minutes=k // 2))
            for k in range(300)]
    p = STR.scratch(spark, "burst_test")
    STR.write_files(_events(spark, rows), p["source"], files, "event_id")
    got = STR.error_burst_stream(spark, p["source"], p["sink"], p["checkpoint"], block=32)
    want, flags = [], {}
    for k, c, act, _, _ in rows:
        f = flags.setdefault(c or "global", [])
        f.append(int(act == "b"))
        if f[-1] and sum(f[-10:]) >= 5:
            want.append((c or "global", k, sum(f[-10:])))
    assert want and sorted((r.monitor_key, r.event_id, r.recent_errors) for r in got.collect()) == sorted(want)


def test_upsert_stream_rewrites_touched_buckets_only(spark):
    schema = "id long, prediction_id string, final_diagnosis string, created_at timestamp"
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 2, 1)
    initial = spark.createDataFrame([(k, f"p{k}", "old", t0) for k in range(100)], schema)
    p = STR.scratch(spark, "upsert_test")
    feed = schema + ", seq int"

    def run(rows):
        df = spark.createDataFrame(rows, feed)
        df.coalesce(1).write.mode("append").parquet(p["source"])
        out = STR.upsert_feedback_stream(spark, p["source"], df.schema, p["target"], initial, p["checkpoint"], t1, buckets=16)
        return {r.prediction_id: (r.id, r.final_diagnosis, r.created_at) for r in out.collect()}, out.count()

    want = {f"p{k}": (k, "old", t0) for k in range(100)}
    got, n = run([(900, "p7", "new", None, 1), (901, "p7", "newer", None, 2)])
    want["p7"] = (7, "newer", t1)
    assert got == want and n == 100
    written = spark.read.parquet(f"{p['target']}/data/v=0").select("bucket").distinct().count()
    assert written == 1  # one of sixteen
    before = sorted(STR._read_manifest(spark, p["target"], 0))
    got, n = run([(902, "q1", "new", None, 1)])  # a restart: the target goes on from version 0
    want["q1"] = (902, "new", t1)
    assert got == want and n == 101
    assert sorted(STR._read_manifest(spark, p["target"], 0)) == before


def test_upsert_stream_replay_writes_the_same_version(spark):
    schema = "id long, prediction_id string, final_diagnosis string, created_at timestamp"
    t1 = datetime(2024, 2, 1)
    initial = spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(k, f"p{k % 5}", f"d{k}", None, k) for k in range(9)], schema + ", seq int")
    p = STR.scratch(spark, "upsert_replay")
    STR.write_files(rows, p["source"], 2, "id")
    results = []
    for attempt in range(2):  # the second checkpoint knows of no micro-batch and runs all of them again
        out = STR.upsert_feedback_stream(spark, p["source"], rows.schema, p["target"], initial, f"{p['checkpoint']}{attempt}", t1, buckets=4)
        results.append((sorted(out.collect()), sorted(STR._read_manifest(spark, p["target"], 1))))
    assert results[0] == results[1] and len(results[0][0]) == 5
