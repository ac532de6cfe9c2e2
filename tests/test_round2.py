"""Cases that caps, prefixes or fixed sizes used to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from looplake.operators import drift as D
from looplake.operators import jobs as J
from looplake.operators import models as MD
from looplake.operators import monitor as M
from looplake.operators import ordering as O
from looplake.operators import trainset as TS
from looplake.plans.registry import load_all
from conftest import SF_SMALL

DRIFT = "temperature double, weight_kg double, heart_rate double, age_months double, animal_type string, gender string, vaccination_status string"


def test_row_numbers_keep_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c")], "k int, v string")
    got = O.with_row_number(df, ["k"], "rn").collect()
    assert sorted(r.rn for r in got) == [1, 2, 3, 4] and sorted(r.v for r in got) == ["a", "a", "b", "c"]


def test_time_split_by_scope_with_repeated_keys(spark):
    rows = [(s, f"r{k}", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), "ab"[k % 2]) for s in ("x", "y") for k in range(40)]
    frame = spark.createDataFrame(rows, "scope_key string, row_key string, sample_ts timestamp, label string")
    got = TS.time_aware_split(frame, 0.25, by=["scope_key"])
    assert got.count() == 80
    assert {(r.scope_key, r.n) for r in got.where("is_validation and time_split_ok").groupBy("scope_key")
            .agg(F.count(F.lit(1)).alias("n")).collect()} == {("x", 10), ("y", 10)}


@pytest.mark.parametrize("rule", ["distance", "p_value"])
def test_drift_with_an_empty_side(spark, rule):
    some = spark.createDataFrame([(38.0, None, 90.0, 12.0, "Dog", None, "ok"), (39.0, None, 95.0, 24.0, "Cat", None, "no")], DRIFT)
    none = some.limit(0)
    for ref, cur in ((some, none), (none, some), (some, some)):
        for r in D.drift_numeric(ref, cur, rule=rule).collect() + D.drift_categorical(ref, cur, rule=rule).collect():
            if r.n_ref and r.n_cur:
                assert r.drift_detected is False
            else:
                assert r.drift_detected is None and min(r.n_ref, r.n_cur) == 0


def test_old_successes_are_found(spark):
    rows = [(k, "c1", "completed" if k == 1 else "failed", k == 1, "v1" if k == 1 else None, dt.datetime(2024, 1, 1)) for k in range(1, 200)]
    jobs = spark.createDataFrame(rows, "training_id long, clinic_id string, status string, is_deployed boolean, "
                                       "new_model_version string, end_time timestamp")
    assert J.last_success_time(jobs).first()[0] == dt.datetime(2024, 1, 1)
    for r in J.last_training(jobs).collect():
        assert (r.last_training_id, r.last_status, r.last_successful_training_id, r.last_successful_version) == (199, "failed", 1, "v1")


def test_monitor_covers_the_whole_log(spark):
    log = spark.range(12_000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit("a").alias("prediction"),
                                     F.when(F.col("id") < 1000, "b").alias("actual"), F.lit(0.5).alias("confidence"))
    assert M.monitor_metrics(log, dt.datetime(2024, 1, 1)).first().error_rate == 1.0
    assert M.prediction_distribution(log).first().n == 12_000


def test_two_class_scoring(spark):
    df = spark.createDataFrame([([0.4, 0.6],), ([1.0, 0.0],)], "probability_arr array<double>")
    got = MD.with_prediction(df, ["no", "yes"]).collect()
    assert [(r.predicted_label, [t.label for t in r.top_k]) for r in got] == [("yes", ["yes", "no"]), ("no", ["no", "yes"])]


def test_skipped_cross_validation_is_reported(spark):
    s = MD.cv_summary(MD.cross_validate(spark.range(1), {}, 1, 3, 0, fallback=(0.9, 0.8))).first()
    assert (s.cv_mean_accuracy, s.cv_std_accuracy, s.cv_mean_f1_weighted, s.n_fits, s.status) == (0.9, 0.0, 0.8, 0, "skipped")


@pytest.mark.parametrize("key", ["train_forest", "training_metrics_row", "batch_score", "monitor_export"])
def test_rows_only_keys_run(spark, key):
    assert load_all()[key].build(spark, SF_SMALL).count() > 0
