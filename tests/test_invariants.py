"""Invariants for keys without a DuckDB oracle (streams, forests, frames), on the smallest tables."""

import hashlib
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from looplake.config import DEFAULT, FEATURES
from looplake.plans.registry import load_all
from looplake.sources.fixtures import Fixtures

REG = load_all()


def test_stream_error_burst_matches_brute_force(spark):
    got = {(r["monitor_key"], r["event_id"], r["recent_errors"])
           for r in REG["stream_error_burst"].build(spark, SF_SMALL).collect()}
    log = Fixtures(spark, SF_SMALL).monitor_log.withColumn("monitor_key", F.coalesce("clinic_id", F.lit("global")))
    wrong = (F.col("actual").isNotNull() & (F.col("prediction") != F.col("actual"))).cast("int")
    w = Window.partitionBy("monitor_key").orderBy("ts", "event_id").rowsBetween(-9, 0)
    ref = log.withColumn("_w", wrong).withColumn("n", F.sum("_w").over(w)).where((F.col("_w") == 1) & (F.col("n") >= 5))
    expect = {(r["monitor_key"], r["event_id"], r["n"]) for r in ref.collect()}
    assert got == expect


def test_stream_auto_trigger_batches(spark):
    out = REG["stream_auto_trigger"].build(spark, SF_SMALL).collect()
    seen = set()
    for r in out:
        ids = [int(x) for x in r["batch_ids"].split(",")]
        assert len(ids) == DEFAULT.auto_batch_size and ids == sorted(ids)
        assert r["batch_start_feedback_id"] == ids[0] and r["batch_end_feedback_id"] == ids[-1]
        assert r["idempotency_key"] == hashlib.sha256(json.dumps(ids, separators=(",", ":")).encode()).hexdigest()
        assert not (set(ids) & seen)
        seen |= set(ids)


def test_frame_weights_in_bounds(spark):
    fr = REG["collect_training_frame"].build(spark, SF_SMALL)
    fb = fr.where(F.col("source") == "feedback").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).first()
    assert fb["lo"] >= DEFAULT.feedback_negative_min_weight and fb["hi"] <= DEFAULT.feedback_positive_max_weight
    other = {(r["source"], r["weight"]) for r in fr.where(F.col("source") != "feedback")
             .select("source", "weight").distinct().collect()}
    assert other <= {("core", DEFAULT.core_memory_quality_score), ("completion", DEFAULT.completion_quality_score)}


def test_forest_beats_majority_on_learnable_label(spark):
    from looplake.operators import evaluate as E
    from looplake.operators import features as FE
    from looplake.operators import models as MD

    base = Fixtures(spark, SF_SMALL).baseline
    frame = (base.withColumn("label", F.col("target_diagnosis")).withColumn("weight", F.lit(1.0))
             .withColumn("row_key", F.col("row_id").cast("string")))
    train = frame.where(F.col("row_id") % 5 != 0)
    test = frame.where(F.col("row_id") % 5 == 0)
    fm = FE.fit_features(train)
    tr = FE.assemble_features(fm, train)
    labels = list(fm.stages[-1].labels)
    model = MD.train_forest(tr, MD.forest_params(tr, len(FEATURES)))
    scored = MD.batch_score(test, fm, model, labels)
    acc = E.classification_metrics(scored, "label", "predicted_label").first()["accuracy"]
    majority = test.groupBy("label").count().agg(F.max("count")).first()[0] / test.count()
    assert acc > majority


def test_warm_start_confidence_in_unit_interval(spark):
    out = REG["warm_start_forest"].build(spark, SF_SMALL)
    assert out.where((F.col("confidence") < 0) | (F.col("confidence") > 1)).count() == 0
    assert out.count() > 0
