"""Catalog: scalars, filters, projections, joins and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from looplake.config import DEFAULT
from looplake.functions import scalars as S
from looplake.operators import scope as SC
from looplake.plans.registry import query
from looplake.sources.fixtures import AS_OF, AS_OF_SQL, WINDOW_DAYS

W = WINDOW_DAYS
WIN_SQL = f"({AS_OF_SQL} - INTERVAL {W} DAY)"
# DuckDB spelling of Python's str.strip() character set.
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS})"


def blank_null_sql(x: str) -> str:
    return f"NULLIF({strip_sql(x)}, '')"


SCOPED_SQL = f"""scoped AS (
  SELECT f.*,
         CASE WHEN f.training_pool = 'GLOBAL' THEN NULL ELSE {blank_null_sql('p.clinic_id')} END AS scope_clinic,
         CASE WHEN f.training_pool = 'GLOBAL' THEN 'global:GLOBAL'
              ELSE 'clinic:' || {blank_null_sql('p.clinic_id')} || ':CLINIC_ONLY' END AS scope_key
  FROM fx_feedback f LEFT JOIN fx_prediction_log p ON f.prediction_id = p.id
  WHERE f.training_pool = 'GLOBAL'
     OR (f.training_pool = 'CLINIC_ONLY' AND {blank_null_sql('p.clinic_id')} IS NOT NULL))"""


# ---------------------------------------------------------------- FLT
@query("eligible_filter", """
SELECT id, prediction_id FROM fx_feedback WHERE COALESCE(is_training_eligible, TRUE)""")
def _eligible_filter(fx):
    return SC.eligible_filter(fx.feedback).select("id", "prediction_id")


@query("window_days_filter", f"""
SELECT id, created_at FROM fx_feedback WHERE created_at >= {WIN_SQL}""")
def _window_days_filter(fx):
    return SC.window_days_filter(fx.feedback, AS_OF, W).select("id", "created_at")


@query("pool_scope_filter", """
SELECT 'global' AS scope, id FROM fx_feedback WHERE training_pool = 'GLOBAL'
UNION ALL
SELECT 'clinic-2' AS scope, f.id FROM fx_feedback f JOIN fx_prediction_log p ON f.prediction_id = p.id
WHERE p.clinic_id = 'clinic-2' AND f.training_pool = 'CLINIC_ONLY'""")
def _pool_scope_filter(fx):
    g = SC.pool_scope_filter(fx.feedback, fx.prediction_log).select(F.lit("global").alias("scope"), "id")
    c = SC.pool_scope_filter(fx.feedback, fx.prediction_log, "clinic-2").select(F.lit("clinic-2").alias("scope"), "id")
    return g.unionByName(c)


@query("id_range_filter", f"""
WITH batch AS (SELECT id FROM fx_feedback WHERE id % 7 = 3 AND created_at >= {WIN_SQL})
SELECT f.id, f.final_diagnosis FROM fx_feedback f
WHERE f.id BETWEEN (SELECT min(id) FROM batch) AND (SELECT max(id) FROM batch)
  AND f.id IN (SELECT id FROM batch)""")
def _id_range_filter(fx):
    batch = SC.window_days_filter(fx.feedback, AS_OF, W).where(F.col("id") % 7 == 3).select("id")
    return SC.id_range_filter(fx.feedback, batch).select("id", "final_diagnosis")


@query("allowlist_filter", """
SELECT f.id, f.prediction_id FROM fx_feedback f
WHERE CAST(f.id AS VARCHAR) IN (SELECT CAST(id AS VARCHAR) FROM fx_feedback WHERE is_correct = FALSE)""")
def _allowlist_filter(fx):
    allow = fx.feedback.where(~F.col("is_correct")).select("id")
    return SC.allowlist_filter(fx.feedback.select("id", "prediction_id"), allow)


@query("label_nonempty", f"""
SELECT row_id FROM fx_bootstrap_raw WHERE {strip_sql('target_diagnosis')} <> ''""")
def _label_nonempty(fx):
    return SC.label_nonempty(fx.bootstrap_raw, "target_diagnosis").select("row_id")


@query("scopes_in_cooldown", f"""
WITH f AS (SELECT DISTINCT CASE WHEN {blank_null_sql('clinic_id')} IS NULL THEN 'global:GLOBAL'
                                ELSE 'clinic:' || {blank_null_sql('clinic_id')} || ':CLINIC_ONLY' END AS scope_key
           FROM fx_job WHERE status = 'failed'),
st AS (SELECT COALESCE(s.scope_key, f.scope_key) AS scope_key,
              CASE WHEN f.scope_key IS NOT NULL
                   THEN {AS_OF_SQL} + to_seconds(CAST(least(900, 30 * pow(2, least(COALESCE(s.consecutive_failures, 0) + 1, 5)))
                                                 AS BIGINT))
                   ELSE s.cooldown_until END AS cooldown_until
       FROM fx_scope_state s FULL OUTER JOIN f ON s.scope_key = f.scope_key)
SELECT scope_key, cooldown_until FROM st WHERE cooldown_until IS NOT NULL AND cooldown_until > {AS_OF_SQL}""")
def _scopes_in_cooldown(fx):
    from looplake.operators import jobs as J
    from looplake.operators import state as ST
    failed = fx.job.where(F.col("status") == "failed").select(J.job_scope_key().alias("scope_key"))
    st = ST.scope_state_failure(fx.scope_state, failed, AS_OF)
    return SC.scopes_in_cooldown(st, AS_OF).select("scope_key", "cooldown_until")


@query("feedback_validate", f"""
WITH stored AS (
  SELECT id AS pid,
         COALESCE({blank_null_sql("json_extract_string(prediction_output, '$.diagnosis')")},
                  {blank_null_sql("json_extract_string(prediction_output, '$.top_k[0].label')")},
                  {blank_null_sql("json_extract_string(top_k_predictions, '$[0].label')")}) AS stored_label
  FROM fx_prediction_log),
j AS (
  SELECT f.id, f.prediction_id, {blank_null_sql('f.final_diagnosis')} AS fin,
         COALESCE({blank_null_sql('f.ai_diagnosis')}, s.stored_label) AS ai, f.is_correct,
         f.confidence_rating, f.data_quality_score, f.training_pool
  FROM fx_feedback f LEFT JOIN stored s ON f.prediction_id = s.pid),
v AS (
  SELECT *, list_filter([
      CASE WHEN fin IS NULL THEN 'final_diagnosis_required' END,
      CASE WHEN ai IS NOT NULL AND fin IS NOT NULL AND is_correct AND lower(fin) <> lower(ai) THEN 'invalid_accept' END,
      CASE WHEN ai IS NOT NULL AND fin IS NOT NULL AND NOT is_correct AND lower(fin) = lower(ai) THEN 'invalid_reject' END,
      CASE WHEN confidence_rating IS NOT NULL AND NOT (confidence_rating BETWEEN 0 AND 5) THEN 'rating_out_of_range' END,
      CASE WHEN data_quality_score IS NOT NULL AND NOT (data_quality_score BETWEEN 0 AND 1) THEN 'quality_out_of_range' END,
      CASE WHEN training_pool IS NOT NULL AND training_pool NOT IN ('GLOBAL', 'CLINIC_ONLY') THEN 'invalid_pool' END
    ], lambda x: x IS NOT NULL) AS vl
  FROM j)
SELECT id, prediction_id, ai AS effective_ai_diagnosis, array_to_string(vl, ',') AS violations,
       CASE WHEN list_contains(vl, 'invalid_accept') THEN 'invalid_accept'
            WHEN list_contains(vl, 'invalid_reject') THEN 'invalid_reject'
            WHEN len(vl) > 0 THEN 'invalid' ELSE 'ok' END AS outcome
FROM v""")
def _feedback_validate(fx):
    return SC.feedback_validate(fx.feedback, fx.prediction_log)


# ---------------------------------------------------------------- PRJ
_FEAT_SQL = """json_extract_string(prediction_input, '$.animal_type') AS animal_type,
       json_extract_string(prediction_input, '$.gender') AS gender,
       CAST(json_extract(prediction_input, '$.age_months') AS INTEGER) AS age_months,
       CAST(json_extract(prediction_input, '$.weight_kg') AS DOUBLE) AS weight_kg,
       CAST(json_extract(prediction_input, '$.temperature') AS DOUBLE) AS temperature,
       CAST(json_extract(prediction_input, '$.heart_rate') AS INTEGER) AS heart_rate,
       json_extract_string(prediction_input, '$.current_season') AS current_season,
       json_extract_string(prediction_input, '$.vaccination_status') AS vaccination_status,
       COALESCE(json_extract_string(prediction_input, '$.medical_history'), 'Unknown') AS medical_history,
       CAST(json_extract(prediction_input, '$.symptom_duration') AS INTEGER) AS symptom_duration,
       COALESCE(json_extract_string(prediction_input, '$.symptoms_list'), '') AS symptoms_list"""


@query("extract_features", f"SELECT id, {_FEAT_SQL} FROM fx_prediction_log")
def _extract_features(fx):
    return SC.extract_features(fx.prediction_log)


@query("stored_diagnosis", f"""
SELECT id, COALESCE({blank_null_sql("json_extract_string(prediction_output, '$.diagnosis')")},
                    {blank_null_sql("json_extract_string(prediction_output, '$.top_k[0].label')")},
                    {blank_null_sql("json_extract_string(top_k_predictions, '$[0].label')")}) AS stored_label
FROM fx_prediction_log""")
def _stored_diagnosis(fx):
    return SC.stored_diagnosis(fx.prediction_log)


@query("resolve_clinic", f"""
SELECT id, COALESCE({blank_null_sql('clinic_id')},
                    {blank_null_sql("json_extract_string(prediction_input, '$.clinic_id')")},
                    {blank_null_sql("json_extract_string(prediction_input, '$.clinicId')")}) AS resolved_clinic_id
FROM fx_prediction_log""")
def _resolve_clinic(fx):
    return SC.resolve_clinic(fx.prediction_log)


_RESOLVE_POOL_SQL = f"""
SELECT f.id, f.prediction_id, {blank_null_sql('p.clinic_id')} AS prediction_clinic_id,
       CASE WHEN f.explicit_pool IN ('GLOBAL', 'CLINIC_ONLY') THEN f.explicit_pool
            WHEN {blank_null_sql('p.clinic_id')} IS NULL THEN 'GLOBAL'
            WHEN upper(pol.feedback_pool) IN ('GLOBAL', 'CLINIC_ONLY') THEN upper(pol.feedback_pool)
            ELSE 'CLINIC_ONLY' END AS resolved_pool
FROM (SELECT *, CASE WHEN id % 5 = 0 THEN training_pool END AS explicit_pool FROM fx_feedback) f
LEFT JOIN fx_prediction_log p ON f.prediction_id = p.id
LEFT JOIN fx_policy pol ON {blank_null_sql('p.clinic_id')} = {strip_sql('pol.clinic_id')}"""


@query("resolve_pool", _RESOLVE_POOL_SQL)
def _resolve_pool(fx):
    fb = fx.feedback.withColumn("explicit_pool", F.when(F.col("id") % 5 == 0, F.col("training_pool")))
    return SC.resolve_pool(fb, fx.prediction_log, fx.policy, explicit_col="explicit_pool")


@query("scope_key", f"""
SELECT f.id,
       CASE WHEN upper({strip_sql("COALESCE(f.training_pool, 'CLINIC_ONLY')")}) = 'GLOBAL' THEN 'global:GLOBAL'
            ELSE 'clinic:' || COALESCE({blank_null_sql('p.clinic_id')}, 'unknown') || ':CLINIC_ONLY' END AS scope_key
FROM fx_feedback f LEFT JOIN fx_prediction_log p ON f.prediction_id = p.id""")
def _scope_key(fx):
    p = fx.prediction_log.select(F.col("id").alias("_pid"), "clinic_id")
    j = fx.feedback.join(p, F.col("prediction_id") == F.col("_pid"), "left")
    return j.select("id", S.scope_key("training_pool", "clinic_id").alias("scope_key"))


@query("training_snapshot", f"""
WITH p AS (SELECT CAST(id AS VARCHAR) AS pid, arg_max(prediction_input, created_at) AS prediction_input
           FROM fx_prediction_log GROUP BY 1),
f AS (SELECT * FROM fx_feedback WHERE is_training_eligible AND created_at >= {WIN_SQL})
SELECT f.prediction_id, strftime(f.created_at, '%Y-%m-%dT%H:%M:%S') AS timestamp, f.final_diagnosis, f.ai_diagnosis,
       f.is_correct, f.confidence_rating, f.data_quality_score,
       json_extract_string(prediction_input, '$.animal_type') AS animal_type,
       json_extract_string(prediction_input, '$.gender') AS gender,
       CAST(json_extract(prediction_input, '$.age_months') AS INTEGER) AS age_months,
       CAST(json_extract(prediction_input, '$.weight_kg') AS DOUBLE) AS weight_kg,
       CAST(json_extract(prediction_input, '$.temperature') AS DOUBLE) AS temperature,
       CAST(json_extract(prediction_input, '$.heart_rate') AS INTEGER) AS heart_rate,
       json_extract_string(prediction_input, '$.current_season') AS current_season,
       json_extract_string(prediction_input, '$.vaccination_status') AS vaccination_status,
       json_extract_string(prediction_input, '$.medical_history') AS medical_history,
       CAST(json_extract(prediction_input, '$.symptom_duration') AS INTEGER) AS symptom_duration,
       json_extract_string(prediction_input, '$.symptoms_list') AS symptoms_list
FROM f JOIN p ON CAST(f.prediction_id AS VARCHAR) = p.pid""")
def _training_snapshot(fx):
    f = SC.eligible_filter(SC.window_days_filter(fx.feedback, AS_OF, W)).withColumnRenamed("created_at", "timestamp")
    return SC.training_snapshot(f, fx.prediction_log)


@query("scope_annotation", f"""
SELECT training_id, CASE WHEN {blank_null_sql('clinic_id')} IS NULL THEN 'global' ELSE 'clinic' END AS training_scope
FROM fx_job""")
def _scope_annotation(fx):
    return SC.scope_annotation(fx.job).select("training_id", "training_scope")


# ---------------------------------------------------------------- JON
@query("feedback_join_predictions", """
SELECT f.id, p.id AS p_id, p.clinic_id AS p_clinic_id FROM fx_feedback f JOIN fx_prediction_log p ON f.prediction_id = p.id""")
def _feedback_join_predictions(fx):
    return SC.feedback_join_predictions(fx.feedback, fx.prediction_log).select("id", "p_id", "p_clinic_id")


@query("feedback_match_text_id", """
SELECT f.id, f.prediction_id, p.created_at AS p_created_at
FROM fx_feedback f JOIN (SELECT CAST(id AS VARCHAR) AS tid, min(created_at) AS created_at FROM fx_prediction_log
                         WHERE id IS NOT NULL GROUP BY 1) p
  ON CAST(f.prediction_id AS VARCHAR) = p.tid""")
def _feedback_match_text_id(fx):
    return SC.feedback_match_text_id(fx.feedback, fx.prediction_log).select("id", "prediction_id", "p_created_at")


@query("orphan_feedback", """
SELECT f.id, f.prediction_id FROM fx_feedback f
WHERE NOT EXISTS (SELECT 1 FROM fx_prediction_log p WHERE CAST(p.id AS VARCHAR) = CAST(f.prediction_id AS VARCHAR))""")
def _orphan_feedback(fx):
    return SC.orphan_feedback(fx.feedback, fx.prediction_log).select("id", "prediction_id")


@query("policy_lookup", f"""
WITH c AS (SELECT DISTINCT {strip_sql("COALESCE(clinic_id, '')")} AS clinic_id FROM fx_prediction_log)
SELECT c.clinic_id,
       CASE WHEN c.clinic_id <> '' AND upper(p.feedback_pool) IN ('GLOBAL', 'CLINIC_ONLY') THEN upper(p.feedback_pool)
            ELSE 'CLINIC_ONLY' END AS feedback_pool
FROM c LEFT JOIN fx_policy p ON c.clinic_id = {strip_sql('p.clinic_id')}""")
def _policy_lookup(fx):
    clinics = fx.prediction_log.select(F.coalesce(F.col("clinic_id"), F.lit("")).alias("clinic_id"))
    return SC.policy_lookup(clinics, fx.policy)


@query("null_safe_scope_join", """
WITH scopes AS (SELECT DISTINCT clinic_id AS scope_clinic FROM fx_job)
SELECT scope_clinic FROM scopes s
WHERE EXISTS (SELECT 1 FROM fx_job j WHERE j.status = 'running' AND j.clinic_id IS NOT DISTINCT FROM s.scope_clinic)""")
def _null_safe_scope_join(fx):
    scopes = fx.job.select(F.col("clinic_id").alias("scope_clinic")).distinct()
    return SC.null_safe_scope_join(scopes, fx.job)


# ---------------------------------------------------------------- AGG
@query("prediction_counts", """
SELECT 'clinic' AS level, clinic_id, count(*) AS prediction_count FROM fx_prediction_log GROUP BY clinic_id
UNION ALL SELECT 'total', NULL, count(*) FROM fx_prediction_log""")
def _prediction_counts(fx):
    return SC.prediction_counts(fx.prediction_log)


@query("feedback_counts", f"""
WITH {SCOPED_SQL}
SELECT scope_key, count(*) AS total, count(*) FILTER (WHERE is_training_eligible) AS eligible,
       count(*) FILTER (WHERE created_at >= {WIN_SQL}) AS in_window,
       count(*) FILTER (WHERE is_training_eligible AND created_at >= {WIN_SQL}) AS eligible_in_window
FROM scoped GROUP BY scope_key""")
def _feedback_counts(fx):
    return SC.feedback_counts(SC.feedback_scopes(fx.feedback, fx.prediction_log), AS_OF, W)


@query("feedback_by_correct", "SELECT is_correct, count(*) AS n FROM fx_feedback GROUP BY is_correct")
def _feedback_by_correct(fx):
    return SC.feedback_by_correct(fx.feedback)


_ELIG_CLINIC_SQL = f"""
SELECT trim(p.clinic_id) AS clinic_id
FROM fx_feedback f JOIN fx_prediction_log p ON p.id = f.prediction_id
WHERE f.training_pool = 'CLINIC_ONLY' AND f.is_training_eligible = TRUE AND f.created_at >= {WIN_SQL}
  AND p.clinic_id IS NOT NULL AND trim(p.clinic_id) <> ''"""


@query("eligible_by_clinic", f"""
SELECT clinic_id, count(*) AS eligible_feedback_count FROM ({_ELIG_CLINIC_SQL}) GROUP BY clinic_id
ORDER BY eligible_feedback_count DESC, clinic_id ASC""")
def _eligible_by_clinic(fx):
    return SC.eligible_by_clinic(fx.feedback, fx.prediction_log, AS_OF, W)


@query("infer_single_clinic", f"""
SELECT count(*) AS n_clinics, CASE WHEN count(*) = 1 THEN min(clinic_id) END AS clinic_id
FROM (SELECT DISTINCT clinic_id FROM ({_ELIG_CLINIC_SQL}))""")
def _infer_single_clinic(fx):
    return SC.infer_single_clinic(fx.feedback, fx.prediction_log, AS_OF, W)


@query("max_feedback_id_by_scope", f"""
WITH {SCOPED_SQL}
SELECT scope_key, CAST(COALESCE(max(id), 0) AS BIGINT) AS max_feedback_id FROM scoped GROUP BY scope_key""")
def _max_feedback_id_by_scope(fx):
    return SC.max_feedback_id_by_scope(SC.feedback_scopes(fx.feedback, fx.prediction_log))


# ---------------------------------------------------------------- SCL
@query("parse_symptoms", f"""
SELECT id, array_to_string(list_filter(list_transform(string_split(COALESCE(
         json_extract_string(prediction_input, '$.symptoms_list'), ''), ','), lambda x: lower({strip_sql('x')})),
         lambda x: x <> ''), '|') AS symptoms
FROM fx_prediction_log""")
def _parse_symptoms(fx):
    sym = F.get_json_object("prediction_input", "$.symptoms_list")
    return fx.prediction_log.select("id", F.array_join(S.parse_symptoms(sym), "|").alias("symptoms"))


@query("normalize_label", f"SELECT row_id, {strip_sql('target_diagnosis')} AS label FROM fx_bootstrap_raw")
def _normalize_label(fx):
    return fx.bootstrap_raw.select("row_id", S.normalize_label("target_diagnosis").alias("label"))


@query("parse_bool_words", f"""
SELECT row_id, CASE WHEN lower({strip_sql('is_correct')}) IN ('true', '1', 'yes', 'y', 'accept', 'accepted') THEN TRUE
                    WHEN lower({strip_sql('is_correct')}) IN ('false', '0', 'no', 'n', 'reject', 'rejected') THEN FALSE
               END AS parsed
FROM fx_bootstrap_raw""")
def _parse_bool_words(fx):
    return fx.bootstrap_raw.select("row_id", S.parse_bool_words("is_correct").alias("parsed"))


@query("clinic_slug", f"""
WITH c AS (SELECT DISTINCT clinic_id FROM fx_prediction_log
           UNION SELECT 'a b/c' UNION SELECT '' UNION SELECT '///' UNION SELECT repeat('x', 201))
SELECT clinic_id,
       CASE WHEN clinic_id IS NULL OR clinic_id = '' THEN 'global'
            WHEN regexp_replace({strip_sql('clinic_id')}, '[^a-zA-Z0-9_.-]+', '_', 'g') = '' THEN 'clinic'
            ELSE regexp_replace({strip_sql('clinic_id')}, '[^a-zA-Z0-9_.-]+', '_', 'g') END AS slug
FROM c""")
def _clinic_slug(fx):
    spark = fx.spark
    extra = spark.createDataFrame([("a b/c",), ("",), ("///",), ("x" * 201,)], "clinic_id string")
    c = fx.prediction_log.select("clinic_id").unionByName(extra).distinct()
    return c.select("clinic_id", S.clinic_slug("clinic_id").alias("slug"))


_W = DEFAULT


@query("feedback_weights", f"""
WITH r AS (SELECT id, data_quality_score AS q,
                  COALESCE(least(greatest(CAST(confidence_rating AS DOUBLE), 0.0), 5.0), 0.0) AS r FROM fx_feedback)
SELECT id, round(least({_W.feedback_positive_max_weight}, q + r / 5.0 * {_W.feedback_delta_max} * {_W.feedback_accept_strength}), 9)
         AS pos_weight,
       round(greatest({_W.feedback_negative_min_weight}, q - (5.0 - r) / 5.0 * {_W.feedback_delta_max} * {_W.feedback_reject_strength}), 9)
         AS neg_weight
FROM r""")
def _feedback_weights(fx):
    pos, neg = S.feedback_weights("data_quality_score", "confidence_rating")
    return fx.feedback.select("id", F.round(pos, 9).alias("pos_weight"), F.round(neg, 9).alias("neg_weight"))


@query("feedback_timestamp", """
SELECT f.id, COALESCE(f.created_at, p.created_at) AS sample_ts
FROM fx_feedback f LEFT JOIN fx_prediction_log p ON f.prediction_id = p.id""")
def _feedback_timestamp(fx):
    p = fx.prediction_log.select(F.col("id").alias("_pid"), F.col("created_at").alias("_pts"))
    j = fx.feedback.join(p, F.col("prediction_id") == F.col("_pid"), "left")
    return j.select("id", S.feedback_timestamp("created_at", "_pts").alias("sample_ts"))


@query("adaptive_split_ratio", f"""
WITH {SCOPED_SQL}
SELECT scope_key, n, CASE WHEN n < 20 THEN 0.1 WHEN n < 50 THEN 0.15 WHEN n < 200 THEN 0.2 ELSE 0.25 END::DOUBLE AS ratio
FROM (SELECT scope_key, count(*) AS n FROM scoped WHERE is_training_eligible AND created_at >= {WIN_SQL}
      GROUP BY scope_key)""")
def _adaptive_split_ratio(fx):
    scoped = SC.eligible_filter(SC.window_days_filter(SC.feedback_scopes(fx.feedback, fx.prediction_log), AS_OF, W))
    n = scoped.groupBy("scope_key").agg(F.count(F.lit(1)).alias("n"))
    return n.select("scope_key", "n", S.adaptive_split_ratio("n").cast("double").alias("ratio"))


@query("cooldown_seconds", f"""
SELECT CASE WHEN {blank_null_sql('clinic_id')} IS NULL THEN 'global:GLOBAL'
            ELSE 'clinic:' || {blank_null_sql('clinic_id')} || ':CLINIC_ONLY' END AS scope_key,
       count(*) AS failures, CAST(least(900, 30 * pow(2, least(count(*), 5))) AS INTEGER) AS cooldown_s
FROM fx_job WHERE status = 'failed' GROUP BY 1""")
def _cooldown_seconds(fx):
    from looplake.operators import jobs as J
    f = fx.job.where(F.col("status") == "failed").groupBy(J.job_scope_key().alias("scope_key")).agg(
        F.count(F.lit(1)).alias("failures"))
    return f.select("scope_key", "failures", S.cooldown_seconds("failures").alias("cooldown_s"))


@query("iso_hour_key", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour FROM fx_monitor_log")
def _iso_hour_key(fx):
    return fx.monitor_log.select("event_id", S.iso_hour_key("ts").alias("hour"))


@query("json_label_paths", f"""
SELECT id, {blank_null_sql("json_extract_string(prediction_output, '$.diagnosis')")} AS output_diagnosis,
       {blank_null_sql("json_extract_string(prediction_output, '$.top_k[0].label')")} AS output_top1,
       {blank_null_sql("json_extract_string(top_k_predictions, '$[0].label')")} AS log_top1
FROM fx_prediction_log""")
def _json_label_paths(fx):
    p = fx.prediction_log
    return p.select("id", S.json_text("prediction_output", "$.diagnosis").alias("output_diagnosis"),
                    S.json_text("prediction_output", "$.top_k[0].label").alias("output_top1"),
                    S.json_text("top_k_predictions", "$[0].label").alias("log_top1"))


@query("audit_snapshot", f"""
WITH {SCOPED_SQL}
SELECT scope_key, CASE WHEN scope_clinic IS NULL THEN 'global' ELSE 'clinic' END AS scope, scope_clinic AS clinic_id,
       {W} AS training_window_days, count(*) AS eligible_feedback_total,
       count(*) FILTER (WHERE is_correct = TRUE) AS feedback_accept_count,
       count(*) FILTER (WHERE is_correct = FALSE) AS feedback_reject_count,
       CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE is_correct = TRUE) AS DOUBLE) / count(*) ELSE 0.0 END
         AS feedback_accept_ratio
FROM scoped WHERE is_training_eligible AND created_at >= {WIN_SQL} GROUP BY scope_key, scope_clinic""")
def _audit_snapshot(fx):
    scoped = SC.eligible_filter(SC.window_days_filter(SC.feedback_scopes(fx.feedback, fx.prediction_log), AS_OF, W))
    return SC.audit_snapshot(scoped, W)
