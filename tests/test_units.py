"""Per-operator unit tests on small literal rows (edge cases of FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from looplake.config import DEFAULT
from looplake.functions import scalars as S
from looplake.operators import evaluate as E
from looplake.operators import jobs as J
from looplake.operators import monitor as M
from looplake.operators import ordering as O
from looplake.operators import registry as R
from looplake.operators import scope as SC
from looplake.operators import state as ST
from looplake.operators import trainset as TS

AS_OF = dt.datetime(2024, 1, 31)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_parse_symptoms(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("Fever, cough",), ("a,, B ,",)], "s string")
    got = [r[0] for r in df.select(S.parse_symptoms("s")).collect()]
    assert got == [[], [], ["fever", "cough"], ["a", "b"]]


def test_feedback_weights(spark):
    df = spark.createDataFrame([(1.0, 5), (1.0, None), (0.6, 0)], "q double, r int")
    pos, neg = S.feedback_weights("q", "r")
    got = [(round(a, 9), round(b, 9)) for a, b in rows(df.select(pos.alias("p"), neg.alias("n")), "p", "n")]
    assert got == [(1.4, 1.0), (1.0, 0.6), (0.6, 0.51)]


def test_explode_feedback_signals(spark):
    df = spark.createDataFrame(
        [(1, "flu", True, "flu"), (2, "flu", False, "flu"), (3, "flu", False, "cold"), (4, "flu", False, None),
         (5, "flu", False, " ")],
        "id long, final_diagnosis string, is_correct boolean, ai_diagnosis string")
    df = (df.withColumn("data_quality_score", F.lit(1.0)).withColumn("confidence_rating", F.lit(5))
          .withColumn("created_at", F.lit(AS_OF)).withColumn("_pts", F.lit(None).cast("timestamp")))
    for f in ("animal_type", "gender", "current_season", "vaccination_status", "medical_history", "symptoms_list"):
        df = df.withColumn(f, F.lit("x"))
    for f in ("age_months", "weight_kg", "temperature", "heart_rate", "symptom_duration"):
        df = df.withColumn(f, F.lit(1))
    out = TS.explode_feedback_signals(df).select("row_key", "label")
    got = sorted(rows(out, "row_key", "label"))
    assert got == [("f:1:pos", "flu"), ("f:2:neg", "flu"), ("f:3:neg", "cold"), ("f:3:pos", "flu"),
                   ("f:4:pos", "flu"), ("f:5:pos", "flu")]


@pytest.mark.parametrize("values,expected", [([], 0.7), ([0.1, 0.2], 0.5), ([0.6, 0.8, 1.0], 0.7)])
def test_quality_threshold(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "weight double")
    assert round(TS.quality_threshold(df).first()["threshold"], 9) == expected


@pytest.mark.parametrize("n,expected", [(10, 2), (1, 0), (100000, 5000)])
def test_core_memory_count(spark, n, expected):
    assert spark.range(1).select(TS.core_memory_count(F.lit(n))).first()[0] == expected


def test_time_aware_split_size(spark):
    df = spark.range(30).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("row_key"),
                                (F.lit(AS_OF) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int")))
                                .alias("sample_ts"),
                                (F.col("id") % 3).cast("string").alias("label"))
    out = TS.time_aware_split(df, 0.15)
    val = sorted(r["row_key"] for r in out.where("is_validation").collect())
    assert val == ["k026", "k027", "k028", "k029"]  # bround(4.5) = 4, the newest rows


def test_upsert_feedback_keeps_old_id(spark):
    tgt = spark.createDataFrame([(1, "p1", "a", AS_OF - dt.timedelta(days=3))],
                                "id long, prediction_id string, final_diagnosis string, created_at timestamp")
    ch = spark.createDataFrame([(9, "p1", "b", AS_OF, 1), (10, "p2", "c", AS_OF, 1)],
                               "id long, prediction_id string, final_diagnosis string, created_at timestamp, seq int")
    got = sorted(rows(ST.upsert_feedback(tgt, ch, AS_OF), "id", "prediction_id", "final_diagnosis", "created_at"))
    assert got == [(1, "p1", "b", AS_OF), (10, "p2", "c", AS_OF)]


def test_upsert_predictions_keeps_clinic(spark):
    tgt = spark.createDataFrame([("1", "c1", "v1", AS_OF)], "id string, clinic_id string, model_version string, "
                                                            "created_at timestamp")
    ch = spark.createDataFrame([("1", None, "v2", AS_OF + dt.timedelta(days=1), 1)],
                               "id string, clinic_id string, model_version string, created_at timestamp, seq int")
    assert rows(ST.upsert_predictions(tgt, ch), "id", "clinic_id", "model_version", "created_at") == \
        [("1", "c1", "v2", AS_OF)]


def test_cooldown_seconds(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 7)], "n int")
    assert [r[0] for r in df.select(S.cooldown_seconds("n")).collect()] == [60, 120, 240, 480, 900, 900]


def test_infer_single_clinic(spark):
    def run(clinics):
        p = spark.createDataFrame([(str(i), c) for i, c in enumerate(clinics)], "id string, clinic_id string")
        f = spark.createDataFrame([(i, str(i), "CLINIC_ONLY", True, AS_OF) for i in range(len(clinics))],
                                  "id long, prediction_id string, training_pool string, is_training_eligible boolean, "
                                  "created_at timestamp")
        return SC.infer_single_clinic(f, p, AS_OF, 30).first()["clinic_id"]
    assert run([]) is None
    assert run(["c1", "c1"]) == "c1"
    assert run(["c1", "c2"]) is None


def test_jobs_by_status_empty(spark):
    jobs = spark.createDataFrame([], "status string")
    assert sorted(rows(J.jobs_by_status(jobs), "status", "job_count")) == [
        ("completed", 0), ("failed", 0), ("pending", 0), ("running", 0)]


def _log(spark, data):
    return spark.createDataFrame(
        [(i, None, p, a, c, 0.1, AS_OF - dt.timedelta(minutes=10 - i)) for i, (p, a, c) in enumerate(data)],
        "event_id long, clinic_id string, prediction string, actual string, confidence double, "
        "latency_seconds double, ts timestamp")


def test_confidence_stats_single_row(spark):
    assert M.confidence_stats(_log(spark, [("a", None, 0.4)])).first()["std"] == 0.0


def test_monitor_accuracy_stale_denominator(spark):
    m = M.monitor_metrics(_log(spark, [("a", "a", 0.9), ("b", None, 0.9), ("c", None, 0.9)]), AS_OF).first()
    assert m["accuracy"] == 1.0 and m["error_rate"] == 0.0 and m["total_predictions"] == 3


def test_hourly_trend_without_labels(spark):
    t = M.hourly_trend(_log(spark, [("a", None, 0.5)]), AS_OF, 24).first()
    assert t["accuracy"] == 0.0 and t["error_rate"] == 1.0


def test_weighted_f1_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    m = E.classification_metrics(df, "y", "p").first()
    assert round(m["f1_weighted"], 9) == round(2 / 3, 9)


def test_threshold_sweep_no_improvement(spark):
    df = spark.createDataFrame([("a", "a", 0.9, "a"), ("b", "b", 0.9, "a")], "y string, p string, m double, maj string")
    r = E.confidence_threshold_sweep(df, "y", "p", "m", "maj").first()
    assert r["best_threshold"] == 0.5 and r["best_f1_weighted"] == r["base_f1"] == 1.0


def test_regression_gate_tolerance(spark):
    def gate(base_correct, new_correct, n=200):
        data = [("a" if i % 2 else "b",) for i in range(n)]
        df = spark.createDataFrame(data, "y string")
        df = df.withColumn("_i", F.monotonically_increasing_id())
        w = Window.orderBy("_i")
        df = df.withColumn("_r", F.row_number().over(w))
        flip = F.when(F.col("y") == "a", "b").otherwise("a")
        df = (df.withColumn("b", F.when(F.col("_r") <= base_correct, F.col("y")).otherwise(flip))
              .withColumn("n", F.when(F.col("_r") <= new_correct, F.col("y")).otherwise(flip)))
        return E.regression_gate(df, "y", "b", "n", F.lit(100)).first()
    assert gate(200, 140)["passed"] is True        # base 1.0 -> tolerance .35
    assert gate(196, 190)["passed"] is False       # base .98 -> tolerance .01


def test_promotion_guardrail_reasons(spark):
    df = spark.createDataFrame([(19, None, None, 0.01), (30, 0.8, 0.9, 0.01), (30, 0.8, None, 0.01)],
                               "n_samples int, cv_mean_f1_weighted double, baseline_metric double, "
                               "cv_std_f1_weighted double")
    got = rows(E.promotion_guardrail(df), "passed", "reason")
    assert got[0] == (False, "n_samples=19 < PROMOTE_MIN_SAMPLES=20; cv_mean_f1_weighted is missing")
    assert got[1] == (False, "cv_mean_f1_weighted_delta=-0.1000 < PROMOTE_MIN_PRIMARY_METRIC_DELTA=0.0000")
    assert got[2] == (True, "passed")


def test_clinic_slug(spark):
    df = spark.createDataFrame([("a b/c",), ("",), ("x" * 201,), ("///",)], "c string")
    got = [r[0] for r in df.select(S.clinic_slug("c")).collect()]
    assert got == ["a_b_c", "global", "x" * 201, "_"]  # whole text: a cut could merge tenants


def test_feedback_validate(spark):
    fb = spark.createDataFrame([(1, "1", " Flu ", True, "flu", None, 1.0, None), (2, "2", "flu", False, "Flu", None, 1.0,
                                                                                   None)],
                               "id long, prediction_id string, final_diagnosis string, is_correct boolean, "
                               "ai_diagnosis string, confidence_rating int, data_quality_score double, "
                               "training_pool string")
    p = spark.createDataFrame([], "id string, prediction_output string, top_k_predictions string")
    got = sorted(rows(SC.feedback_validate(fb, p), "id", "outcome"))
    assert got == [(1, "ok"), (2, "invalid_reject")]


def test_next_version_numeric_order(spark):
    reg = spark.createDataFrame([(None, "v1.9"), (None, "v1.10")], "clinic_id string, version string")
    assert R.next_version(reg).first()["next_version"] == "v1.11"


@pytest.mark.parametrize("x,d", [(0.015, 2), (0.125, 2), (0.135, 2), (0.145, 2), (2.675, 2), (1.0, 1),
                                 (0.0, 2), (-0.125, 2), (0.123456789, 4)])
def test_py_fixed_matches_python(spark, x, d):
    got = spark.range(1).select(S.py_fixed(F.lit(x), d)).first()[0]
    assert got == f"{x:.{d}f}"


def test_with_row_number_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 5000).alias("k"))
    got = O.with_row_number(df, ["k"], "rn", partition_cols=["g"], num_partitions=5)
    ref = df.withColumn("rn_ref", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    j = got.join(ref, ["g", "k"])
    assert j.where(F.col("rn") != F.col("rn_ref")).count() == 0 and j.count() == 5000


def test_trailing_and_running_match_window(spark):
    df = spark.range(1, 3001).select(F.col("id").alias("rn"), ((F.col("id") * 31) % 7).alias("v"))
    t = O.trailing_sum(df, "rn", F.col("v"), 10, "s", block=250)
    r = O.running_totals(df, "rn", {"c": F.col("v")}, block=250)
    w = Window.orderBy("rn")
    ref = df.select("rn", F.sum("v").over(w.rowsBetween(-9, 0)).alias("s_ref"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c_ref"))
    j = t.join(r.select("rn", "c"), "rn").join(ref, "rn")
    assert j.where((F.col("s") != F.col("s_ref")) | (F.col("c") != F.col("c_ref"))).count() == 0
    assert j.count() == 3000


def test_batch_idempotency_key_matches_python(spark):
    import hashlib
    import json
    ids = [10, 2, 1]
    expect = hashlib.sha256(json.dumps(sorted(ids), separators=(",", ":")).encode()).hexdigest()
    df = spark.createDataFrame([(ids,)], "ids array<bigint>")
    assert df.select(S.batch_idempotency_key("ids")).first()[0] == expect


def test_split_seed_matches_python(spark):
    import hashlib
    rows_ = [(1, "p1", " Flu ", AS_OF), (2, "p2", "Cold", AS_OF + dt.timedelta(seconds=1))]
    h = hashlib.sha256()
    h.update(b"42")
    h.update(b"no-training-id")
    for _, pid, fin, _ in rows_:
        h.update(pid.encode())
        h.update(fin.strip().lower().encode())
        h.update(b"|")
    expect = int.from_bytes(h.digest()[:4], "big") & 0x7FFFFFFF
    df = spark.createDataFrame(rows_, "id long, prediction_id string, final_diagnosis string, created_at timestamp")
    assert TS.split_seed(df.withColumn("g", F.lit(1)), ["g"]).first()["split_seed"] == expect
