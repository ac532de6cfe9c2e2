"""Catalog: sources, ingest, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from looplake.config import FEATURES, LABEL
from looplake.operators import scope as SC
from looplake.operators import state as ST
from looplake.operators import trainset as TS
from looplake.plans.catalog_scope import WIN_SQL, WS, strip_sql
from looplake.plans.catalog_state import BATCHES_SQL
from looplake.plans.catalog_train import MIX_SQL
from looplake.plans.catalog_scope import SCOPED_SQL, blank_null_sql
from looplake.plans.registry import query
from looplake.sources import ingest as I
from looplake.sources.fixtures import AS_OF, BATCH_T, WINDOW_DAYS

W = WINDOW_DAYS


@query("scan_predictions", """
SELECT 'all' AS scope, id, clinic_id, created_at FROM fx_prediction_log
UNION ALL SELECT 'clinic-2', id, clinic_id, created_at FROM fx_prediction_log WHERE clinic_id = 'clinic-2'""")
def _scan_predictions(fx):
    a = SC.scan_predictions(fx.prediction_log).select(F.lit("all").alias("scope"), "id", "clinic_id", "created_at")
    c = SC.scan_predictions(fx.prediction_log, "clinic-2").select(F.lit("clinic-2").alias("scope"), "id", "clinic_id",
                                                                  "created_at")
    return a.unionByName(c)


@query("scan_feedback", f"""
SELECT 'global' AS scope, id, prediction_id, created_at AS timestamp FROM fx_feedback
WHERE training_pool = 'GLOBAL' AND is_training_eligible AND created_at >= {WIN_SQL}
UNION ALL
SELECT 'clinic-2', f.id, f.prediction_id, f.created_at FROM fx_feedback f JOIN fx_prediction_log p ON f.prediction_id = p.id
WHERE p.clinic_id = 'clinic-2' AND f.training_pool = 'CLINIC_ONLY' AND f.is_training_eligible AND f.created_at >= {WIN_SQL}
  AND f.id >= 1000 AND f.id <= 9000""")
def _scan_feedback(fx):
    g = SC.scan_feedback(fx.feedback, eligible_only=True, days=W, as_of=AS_OF)
    c = SC.scan_feedback(fx.feedback, fx.prediction_log, eligible_only=True, days=W, clinic_id="clinic-2",
                         id_min=1000, id_max=9000, as_of=AS_OF)
    return (g.select(F.lit("global").alias("scope"), "id", "prediction_id", "timestamp")
            .unionByName(c.select(F.lit("clinic-2").alias("scope"), "id", "prediction_id", "timestamp")))


@query("scan_worker_inputs", f"""
SELECT f.prediction_id, f.final_diagnosis, f.is_correct, f.data_quality_score, f.created_at AS timestamp
FROM fx_feedback f JOIN fx_prediction_log p ON f.prediction_id = p.id
WHERE p.clinic_id = 'clinic-3' AND f.training_pool = 'CLINIC_ONLY' AND f.is_training_eligible
  AND f.created_at >= {WIN_SQL}""")
def _scan_worker_inputs(fx):
    f = SC.scan_feedback(fx.feedback, fx.prediction_log, eligible_only=True, days=W, clinic_id="clinic-3", as_of=AS_OF)
    return f.select("prediction_id", "final_diagnosis", "is_correct", "data_quality_score", "timestamp")


@query("scan_json_inputs", "SELECT id, prediction_id, data_quality_score, created_at FROM fx_feedback")
def _scan_json_inputs(fx):
    path = I.shared_path(fx.spark, "feedback-json")
    I.write_json_records(fx.feedback, path)
    back = I.read_json_records(fx.spark, path, I.FEEDBACK_SCHEMA)
    return back.select("id", "prediction_id", "data_quality_score", "created_at")


@query("scan_baseline", f"""
SELECT 'features' AS projection, {", ".join(FEATURES)}, {LABEL} FROM fx_baseline
UNION ALL SELECT 'label', {", ".join("NULL" for _ in FEATURES)}, {LABEL} FROM fx_baseline""")
def _scan_baseline(fx):
    path = I.shared_path(fx.spark, "baseline-csv")
    I.write_csv(fx.baseline, path)
    full = I.read_baseline_csv(fx.spark, path).select(F.lit("features").alias("projection"), *FEATURES, LABEL)
    lab = I.read_baseline_csv(fx.spark, path, label_only=True)
    lab = lab.select(F.lit("label").alias("projection"), *[F.lit(None).cast(t).alias(c) for c, t in
                                                             [(f.name, f.dataType) for f in I.BASELINE_SCHEMA.fields
                                                              if f.name in FEATURES]], LABEL)
    return full.unionByName(lab)


def _nan_text_sql(c):
    return f"({c} IS NULL OR {strip_sql(c)} = '' OR lower({strip_sql(c)}) = 'nan')"


_VALIDATE_SQL = f"""
rep AS (
  SELECT row_id AS line_no,
         list_filter([
           CASE WHEN {_nan_text_sql('target_diagnosis')} THEN 'no_label' END,
           {", ".join(f"CASE WHEN {c} IS NOT NULL AND {strip_sql(c)} <> '' AND TRY_CAST({strip_sql(c)} AS DOUBLE) IS NULL THEN 'invalid_numeric:{c}' END" for c in I.BOOTSTRAP_INT + I.BOOTSTRAP_FLOAT)},
           {", ".join(f"CASE WHEN {c} IS NULL OR {strip_sql(c)} = '' THEN 'missing_numeric:{c}' END" for c in I.BOOTSTRAP_INT)},
           {", ".join(f"CASE WHEN {_nan_text_sql(c)} THEN 'invalid_text:{c}' END" for c in I.BOOTSTRAP_TEXT)}
         ], lambda x: x IS NOT NULL) AS el,
         NOT {_nan_text_sql('target_diagnosis')} AS has_label
  FROM fx_bootstrap_raw)"""


@query("bootstrap_validate", f"""
WITH {_VALIDATE_SQL}
SELECT line_no, array_to_string(el, ',') AS errors, len(list_filter(el, lambda x: x <> 'no_label')) = 0 AS is_valid,
       has_label FROM rep""")
def _bootstrap_validate(fx):
    raw = fx.bootstrap_raw.withColumnRenamed("row_id", "line_no")
    return I.bootstrap_validate(raw)


@query("bootstrap_ingest", f"""
WITH {_VALIDATE_SQL},
j AS (SELECT r.*, rep.el, row_number() OVER (ORDER BY r.row_id) AS i
      FROM fx_bootstrap_raw r JOIN rep ON r.row_id = rep.line_no WHERE rep.has_label),
good AS (SELECT * FROM j WHERE len(list_filter(el, lambda x: x <> 'no_label')) = 0)
SELECT sha256('fx:' || row_id) AS prediction_id,
       CASE WHEN {blank_null_sql('pet_id')} IS NULL THEN 'bootstrap' ELSE {strip_sql('pet_id')} END AS pet_id,
       CAST(trunc(CAST({strip_sql('age_months')} AS DOUBLE)) AS INTEGER) AS age_months,
       CAST({strip_sql('weight_kg')} AS DOUBLE) AS weight_kg,
       CAST(trunc(CAST({strip_sql('heart_rate')} AS DOUBLE)) AS INTEGER) AS heart_rate,
       COALESCE({blank_null_sql('medical_history')}, 'Unknown') AS medical_history,
       {strip_sql('target_diagnosis')} AS final_diagnosis,
       CASE WHEN {_nan_text_sql('ai_diagnosis')} THEN {strip_sql('target_diagnosis')} ELSE {strip_sql('ai_diagnosis')} END
         AS ai_diagnosis,
       COALESCE(CASE WHEN lower({strip_sql('is_correct')}) IN ('true', '1', 'yes', 'y', 'accept', 'accepted') THEN TRUE
                     WHEN lower({strip_sql('is_correct')}) IN ('false', '0', 'no', 'n', 'reject', 'rejected') THEN FALSE END,
                TRUE) AS is_correct,
       TIMESTAMP '2024-01-31 00:00:00' + to_seconds(i - 1) AS created_at
FROM good""")
def _bootstrap_ingest(fx):
    raw = fx.bootstrap_raw.withColumnRenamed("row_id", "line_no")
    out = I.bootstrap_ingest(raw, AS_OF, "fx")
    return out.select("prediction_id", "pet_id", "age_months", "weight_kg", "heart_rate", "medical_history",
                      "final_diagnosis", "ai_diagnosis", "is_correct", "created_at")


@query("input_contract_check", f"""
WITH v AS (
  SELECT unnest(list_filter([
           {", ".join(f"CASE WHEN json_extract(prediction_input, '$.{c}') IS NULL THEN 'missing:{c}' END" for c in I.CONTRACT_REQUIRED)},
           CASE WHEN lower({strip_sql("COALESCE(json_extract_string(prediction_input, '$.animal_type'), '')")}) NOT IN ('dog', 'cat')
                THEN 'animal_type_domain' END,
           CASE WHEN COALESCE({blank_null_sql("json_extract_string(prediction_output, '$.diagnosis')")},
                              {blank_null_sql("json_extract_string(prediction_output, '$.top_k[0].label')")},
                              {blank_null_sql("json_extract_string(top_k_predictions, '$[0].label')")}) IS NULL
                THEN 'label_missing' END], lambda x: x IS NOT NULL)) AS rule
  FROM fx_prediction_log)
SELECT rule, count(*) AS violations FROM v GROUP BY rule""")
def _input_contract_check(fx):
    from looplake.functions import scalars as S
    p = fx.prediction_log
    return I.input_contract_check(p, S.stored_diagnosis("prediction_output", "top_k_predictions"))


@query("widen_legacy_ids", """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id + 7 AS VARCHAR) AS visit_id,
       CAST(user_id % 10 AS VARCHAR) AS clinic_id, 'v1.0' AS model_version,
       CAST(NULL AS DOUBLE) AS confidence_score FROM events""")
def _widen_legacy_ids(fx):
    legacy = fx.table("events").select(F.col("event_id").alias("id"), (F.col("event_id") + 7).alias("visit_id"),
                                       (F.col("user_id") % 10).cast("int").alias("clinic_id"))
    c = I.conform(legacy, I.PREDICTION_SCHEMA, defaults={"model_version": "v1.0"})
    return c.select("id", "visit_id", "clinic_id", "model_version", "confidence_score")


_SNAPSHOT_SQL = f"""
WITH {SCOPED_SQL}, {BATCHES_SQL},
sn AS (SELECT b.scope_key, b.batch_no AS training_id, f.* FROM batches b JOIN fx_feedback f ON b.id = f.id)"""


def _snapshot(fx):
    scoped = SC.feedback_scopes(fx.feedback, fx.prediction_log)
    b = (ST.watermark_batches(scoped, fx.scope_state, AS_OF, W, BATCH_T)
         .select("scope_key", F.col("batch_no").alias("training_id"), "id"))
    f = b.join(fx.feedback, "id").withColumnRenamed("created_at", "timestamp")
    snap = SC.training_snapshot(f, fx.prediction_log)
    return snap.join(f.select("prediction_id", "scope_key", "training_id"), "prediction_id")


@query("dataset_summary", f"""{_SNAPSHOT_SQL}
SELECT scope_key, training_id, count(*) AS row_count,
       'prediction_id,timestamp,final_diagnosis,ai_diagnosis,is_correct,confidence_rating,data_quality_score,{",".join(FEATURES)}'
         AS columns
FROM sn WHERE prediction_id IN (SELECT id FROM fx_prediction_log) GROUP BY scope_key, training_id""")
def _dataset_summary(fx):
    return I.dataset_summary(_snapshot(fx), ["scope_key", "training_id"])


def _txt(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


_EXPORT_SQL = _SNAPSHOT_SQL + f""",
pp AS (SELECT CAST(id AS VARCHAR) AS pid, arg_max(prediction_input, created_at) AS pin FROM fx_prediction_log GROUP BY 1)
SELECT {_txt('sn.prediction_id')} AS prediction_id, strftime(sn.created_at, '%Y-%m-%dT%H:%M:%S') AS timestamp,
       sn.final_diagnosis, sn.ai_diagnosis, {_txt('sn.is_correct')} AS is_correct,
       {_txt('sn.confidence_rating')} AS confidence_rating, {_txt('sn.data_quality_score')} AS data_quality_score,
       json_extract_string(pin, '$.animal_type') AS animal_type, json_extract_string(pin, '$.gender') AS gender,
       {_txt("CAST(json_extract(pin, '$.age_months') AS INTEGER)")} AS age_months,
       {_txt("CAST(json_extract(pin, '$.weight_kg') AS DOUBLE)")} AS weight_kg,
       {_txt("CAST(json_extract(pin, '$.temperature') AS DOUBLE)")} AS temperature,
       {_txt("CAST(json_extract(pin, '$.heart_rate') AS INTEGER)")} AS heart_rate,
       json_extract_string(pin, '$.current_season') AS current_season,
       json_extract_string(pin, '$.vaccination_status') AS vaccination_status,
       json_extract_string(pin, '$.medical_history') AS medical_history,
       {_txt("CAST(json_extract(pin, '$.symptom_duration') AS INTEGER)")} AS symptom_duration,
       NULLIF(json_extract_string(pin, '$.symptoms_list'), '') AS symptoms_list,
       sn.scope_key, CAST(sn.training_id AS INTEGER) AS training_id
FROM sn JOIN pp ON CAST(sn.prediction_id AS VARCHAR) = pp.pid"""


@query("dataset_export", _EXPORT_SQL)
def _dataset_export(fx):
    """Snapshots of all scopes written as CSV per scope and training id and read back (every value as text; as in the
    reference's CSV writer, an empty text and a missing value are the same empty field)."""
    path, by = I.shared_path(fx.spark, "dataset-export"), ["scope_key", "training_id"]
    rows = _snapshot(fx)
    I.dataset_export(rows, path, by)
    return I.read_export(fx.spark, path, rows.schema, by)


@query("stage_tables", f"""
WITH {MIX_SQL}
SELECT scope_key, source, row_key, label, round(weight, 9) AS weight, sample_ts FROM frame""")
def _stage_tables(fx):
    """Training frame saved as a stage table and loaded back by (stage, run id)."""
    root = I.shared_path(fx.spark, "stages")
    frame = TS.collect_training_frame(
        SC.eligible_filter(SC.window_days_filter(SC.feedback_scopes(fx.feedback, fx.prediction_log), AS_OF, W)),
        fx.prediction_log, fx.baseline, AS_OF)
    I.save_stage(frame, root, "data_prep", "run-1")
    back = I.load_stage(fx.spark, root, "data_prep", "run-1")
    return back.select("scope_key", "source", "row_key", "label", F.round("weight", 9).alias("weight"), "sample_ts")

