"""Catalog: training-set construction, sets (§2.8), order-dependent picks (§2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from looplake.config import DEFAULT, FEATURES
from looplake.functions import scalars as S
from looplake.operators import scope as SC
from looplake.operators import state as ST
from looplake.operators import trainset as TS
from looplake.plans.catalog_scope import SCOPED_SQL, WIN_SQL, WS, strip_sql
from looplake.plans.catalog_state import BATCHES_SQL
from looplake.plans.registry import query
from looplake.sources.fixtures import AS_OF, BATCH_T, SEED, WINDOW_DAYS

W, C = WINDOW_DAYS, DEFAULT
FEATS = ", ".join(FEATURES)


def feats_sql(src: str = "pin") -> str:
    return f"""json_extract_string({src}, '$.animal_type') AS animal_type,
       json_extract_string({src}, '$.gender') AS gender,
       CAST(json_extract({src}, '$.age_months') AS INTEGER) AS age_months,
       CAST(json_extract({src}, '$.weight_kg') AS DOUBLE) AS weight_kg,
       CAST(json_extract({src}, '$.temperature') AS DOUBLE) AS temperature,
       CAST(json_extract({src}, '$.heart_rate') AS INTEGER) AS heart_rate,
       json_extract_string({src}, '$.current_season') AS current_season,
       json_extract_string({src}, '$.vaccination_status') AS vaccination_status,
       COALESCE(json_extract_string({src}, '$.medical_history'), 'Unknown') AS medical_history,
       CAST(json_extract({src}, '$.symptom_duration') AS INTEGER) AS symptom_duration,
       COALESCE(json_extract_string({src}, '$.symptoms_list'), '') AS symptoms_list"""


HASH = f"sha256('{SEED}:' || CAST(row_id AS VARCHAR))"

MATCHED_SQL = f"""{SCOPED_SQL},
fb AS (SELECT * FROM scoped WHERE is_training_eligible AND created_at >= {WIN_SQL}),
pp AS (SELECT CAST(id AS VARCHAR) AS tid, arg_min(prediction_input, created_at) AS pin, min(created_at) AS pts
       FROM fx_prediction_log WHERE id IS NOT NULL GROUP BY 1),
m AS (SELECT fb.*, pp.pts, {feats_sql('pp.pin')} FROM fb JOIN pp ON CAST(fb.prediction_id AS VARCHAR) = pp.tid),
wq AS (SELECT *, COALESCE(data_quality_score, 1.0) AS q,
              COALESCE(least(greatest(CAST(confidence_rating AS DOUBLE), 0.0), 5.0), 0.0) AS r FROM m),
w AS (SELECT *, least({C.feedback_positive_max_weight}, q + r / 5.0 * {C.feedback_delta_max} * {C.feedback_accept_strength})
                  AS pos_w,
              greatest({C.feedback_negative_min_weight}, q - (5.0 - r) / 5.0 * {C.feedback_delta_max} * {C.feedback_reject_strength})
                  AS neg_w,
              COALESCE(is_correct, FALSE) AS ok, (ai_diagnosis IS NOT NULL AND final_diagnosis = ai_diagnosis) AS same
      FROM wq),
sig AS (
  SELECT scope_key, 'feedback' AS source, 'f:' || id || ':pos' AS row_key, {FEATS}, final_diagnosis AS label,
         pos_w AS weight, COALESCE(created_at, pts) AS sample_ts FROM w WHERE ok OR NOT same
  UNION ALL
  SELECT scope_key, 'feedback', 'f:' || id || ':neg', {FEATS}, final_diagnosis, neg_w, COALESCE(created_at, pts)
  FROM w WHERE NOT ok AND same
  UNION ALL
  SELECT scope_key, 'feedback', 'f:' || id || ':neg', {FEATS}, ai_diagnosis, neg_w, COALESCE(created_at, pts)
  FROM w WHERE NOT ok AND NOT same AND ai_diagnosis IS NOT NULL AND trim(ai_diagnosis, {WS}) <> ''),
thr AS (SELECT scope_key, greatest({C.quality_min_threshold}, quantile_cont(weight, {C.quality_percentile / 100})) AS threshold
        FROM sig GROUP BY scope_key),
kept AS (SELECT sig.* FROM sig JOIN thr ON sig.scope_key = thr.scope_key WHERE weight >= threshold)"""

MIX_SQL = f"""{MATCHED_SQL},
ncore AS (SELECT scope_key, greatest(0, least(CAST(round_even(CAST(count(*) AS DOUBLE) * {C.core_memory_ratio}
                 / {1.0 - C.core_memory_ratio}, 0) AS BIGINT), {C.core_memory_max_rows})) AS core_n
          FROM kept GROUP BY scope_key),
cand AS (SELECT *, row_number() OVER (ORDER BY {HASH}, row_id) AS pos FROM fx_baseline
         QUALIFY pos <= {C.core_memory_max_rows}),
core AS (SELECT ncore.scope_key, 'core' AS source, 'c:' || row_id AS row_key, {FEATS},
                CAST(target_diagnosis AS VARCHAR) AS label, {C.core_memory_quality_score} AS weight,
                TIMESTAMP '1970-01-01 00:00:00' AS sample_ts
         FROM ncore JOIN cand ON cand.pos <= ncore.core_n),
mixed AS (SELECT * FROM kept UNION ALL SELECT * FROM core),
blabels AS (SELECT DISTINCT CAST(target_diagnosis AS VARCHAR) AS label FROM fx_baseline),
missing AS (SELECT s.scope_key, l.label FROM (SELECT DISTINCT scope_key FROM mixed) s CROSS JOIN blabels l
            EXCEPT SELECT DISTINCT scope_key, label FROM mixed),
picks AS (SELECT * FROM fx_baseline
          QUALIFY row_number() OVER (PARTITION BY target_diagnosis ORDER BY {HASH}, row_id) <= {C.completion_per_missing_class}),
comp AS (SELECT mi.scope_key, 'completion' AS source, 'm:' || row_id AS row_key, animal_type, gender, age_months,
                weight_kg, temperature, heart_rate, current_season, vaccination_status,
                COALESCE(medical_history, 'Unknown') AS medical_history, symptom_duration,
                COALESCE(symptoms_list, '') AS symptoms_list, mi.label, {C.completion_quality_score} AS weight,
                TIMESTAMP '1970-01-02 00:00:00' AS sample_ts
         FROM missing mi JOIN picks p ON CAST(p.target_diagnosis AS VARCHAR) = mi.label),
frame AS (SELECT * FROM mixed UNION ALL SELECT * FROM comp)"""


def _scoped_eligible(fx):
    return SC.eligible_filter(SC.window_days_filter(SC.feedback_scopes(fx.feedback, fx.prediction_log), AS_OF, W))


def _frame(fx):
    return TS.collect_training_frame(_scoped_eligible(fx), fx.prediction_log, fx.baseline, AS_OF)


@query("collect_training_frame", f"""
WITH {MIX_SQL}
SELECT scope_key, source, row_key, {FEATS}, label, round(weight, 9) AS weight, sample_ts FROM frame""")
def _collect_training_frame(fx):
    return _frame(fx).withColumn("weight", F.round("weight", 9))


@query("explode_feedback_signals", f"""
WITH {MATCHED_SQL}
SELECT scope_key, row_key, label, round(weight, 9) AS weight, sample_ts FROM sig""")
def _explode_feedback_signals(fx):
    sig = TS.explode_feedback_signals(TS.match_feedback(_scoped_eligible(fx), fx.prediction_log))
    return sig.select("scope_key", "row_key", "label", F.round("weight", 9).alias("weight"), "sample_ts")


@query("quality_threshold", f"""
WITH {MATCHED_SQL}
SELECT scope_key, round(threshold, 9) AS threshold FROM thr""")
def _quality_threshold(fx):
    sig = TS.explode_feedback_signals(TS.match_feedback(_scoped_eligible(fx), fx.prediction_log))
    return TS.quality_threshold(sig, by=["scope_key"]).select("scope_key", F.round("threshold", 9).alias("threshold"))


@query("quality_filter", f"""
WITH {MATCHED_SQL}
SELECT scope_key, row_key FROM kept""")
def _quality_filter(fx):
    sig = TS.explode_feedback_signals(TS.match_feedback(_scoped_eligible(fx), fx.prediction_log))
    thr = TS.quality_threshold(sig, by=["scope_key"])
    return TS.quality_filter(sig, thr, by=["scope_key"]).select("scope_key", "row_key")


@query("mix_core_memory", f"""
WITH {MIX_SQL}
SELECT scope_key, source, row_key, label FROM mixed""")
def _mix_core_memory(fx):
    sig = TS.explode_feedback_signals(TS.match_feedback(_scoped_eligible(fx), fx.prediction_log))
    kept = TS.quality_filter(sig, TS.quality_threshold(sig, by=["scope_key"]), by=["scope_key"])
    return TS.mix_core_memory(kept, fx.baseline).select("scope_key", "source", "row_key", "label")


@query("complete_classes", f"""
WITH {MIX_SQL}
SELECT scope_key, row_key, label, medical_history, symptoms_list FROM comp""")
def _complete_classes(fx):
    return _frame(fx).where(F.col("source") == "completion").select(
        "scope_key", "row_key", "label", "medical_history", "symptoms_list")


@query("label_difference", f"""
WITH {MIX_SQL}
SELECT s.scope_key, b.label FROM (SELECT DISTINCT scope_key FROM kept) s CROSS JOIN blabels b
EXCEPT SELECT scope_key, label FROM kept""")
def _label_difference(fx):
    sig = TS.explode_feedback_signals(TS.match_feedback(_scoped_eligible(fx), fx.prediction_log))
    kept = TS.quality_filter(sig, TS.quality_threshold(sig, by=["scope_key"]), by=["scope_key"])
    return TS.label_difference(fx.baseline.select(F.col("target_diagnosis").alias("label")), kept, by=["scope_key"])


@query("per_class_pick", f"""
SELECT target_diagnosis, row_id FROM fx_baseline
QUALIFY row_number() OVER (PARTITION BY target_diagnosis ORDER BY {HASH}, row_id) <= 3""")
def _per_class_pick(fx):
    return TS.per_class_pick(fx.baseline, "target_diagnosis", 3, SEED, "row_id").select("target_diagnosis", "row_id")


@query("fill_missing_timestamps", f"""
WITH f AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE created_at END AS sample_ts FROM fx_feedback
           WHERE is_training_eligible)
SELECT id, COALESCE(sample_ts, TIMESTAMP '2024-01-31 00:00:00'
       + to_seconds(row_number() OVER (PARTITION BY sample_ts IS NULL ORDER BY id) - 1)) AS sample_ts FROM f""")
def _fill_missing_timestamps(fx):
    f = (fx.feedback.where(F.col("is_training_eligible"))
         .select("id", F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("created_at")).alias("sample_ts"))
         .withColumn("scope_key", F.lit("all")).withColumn("row_key", F.col("id")))
    return TS.fill_missing_timestamps(f, AS_OF, "row_key").select("id", "sample_ts")


@query("feedback_only_frame", f"""
WITH {SCOPED_SQL},
fb AS (SELECT * FROM scoped WHERE is_training_eligible AND created_at >= {WIN_SQL}),
pp AS (SELECT CAST(id AS VARCHAR) AS tid, arg_min(prediction_input, created_at) AS pin FROM fx_prediction_log
       WHERE id IS NOT NULL GROUP BY 1),
m AS (SELECT fb.scope_key, fb.id, fb.final_diagnosis AS label, COALESCE(fb.data_quality_score, 1.0) AS quality,
             {feats_sql('pp.pin')}
      FROM fb JOIN pp ON CAST(fb.prediction_id AS VARCHAR) = pp.tid),
thr AS (SELECT scope_key, greatest(0.5, quantile_cont(quality, 0.25)) AS threshold FROM m GROUP BY scope_key)
SELECT m.scope_key, m.id, m.label, m.quality, m.animal_type, m.heart_rate FROM m JOIN thr ON m.scope_key = thr.scope_key
WHERE quality >= threshold""")
def _feedback_only_frame(fx):
    return TS.feedback_only_frame(_scoped_eligible(fx), fx.prediction_log).select(
        "scope_key", "id", "label", "quality", "animal_type", "heart_rate")


@query("class_distribution", f"""
WITH {MIX_SQL},
c AS (SELECT scope_key, label, count(*) AS n FROM frame GROUP BY scope_key, label)
SELECT scope_key, label, n, count(*) OVER (PARTITION BY scope_key) AS n_classes,
       count(*) OVER (PARTITION BY scope_key) >= 2 AS diversity_ok FROM c""")
def _class_distribution(fx):
    return TS.class_distribution(_frame(fx), by=["scope_key"])


@query("balanced_class_weights", """
WITH c AS (SELECT CAST(target_diagnosis AS VARCHAR) AS label, count(*) AS c FROM fx_baseline GROUP BY 1)
SELECT label, CAST((SELECT sum(c) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * c) AS class_weight FROM c""")
def _balanced_class_weights(fx):
    return TS.balanced_class_weights(fx.baseline)


@query("apply_class_weights", f"""
WITH {MIX_SQL},
cw AS (SELECT label, CAST((SELECT count(*) FROM fx_baseline) AS DOUBLE)
                     / ((SELECT count(DISTINCT target_diagnosis) FROM fx_baseline) * count(*)) AS class_weight
       FROM (SELECT CAST(target_diagnosis AS VARCHAR) AS label FROM fx_baseline) GROUP BY label)
SELECT f.scope_key, f.row_key, round(f.weight * COALESCE(cw.class_weight, 1.0), 9) AS weight
FROM frame f LEFT JOIN cw ON f.label = cw.label""")
def _apply_class_weights(fx):
    out = TS.apply_class_weights(_frame(fx), TS.balanced_class_weights(fx.baseline))
    return out.select("scope_key", "row_key", F.round("weight", 9).alias("weight"))


@query("majority_class", f"""
WITH {MIX_SQL}
SELECT scope_key, label AS majority_label FROM (
  SELECT scope_key, label, row_number() OVER (PARTITION BY scope_key ORDER BY count(*) DESC, label) AS r
  FROM frame GROUP BY scope_key, label) WHERE r = 1""")
def _majority_class(fx):
    return TS.majority_class(_frame(fx), by=["scope_key"])


@query("accept_only_note", f"""
WITH {SCOPED_SQL},
a AS (SELECT scope_key, count(*) AS n, bool_or(is_correct = FALSE) AS has_reject FROM scoped
      WHERE is_training_eligible AND created_at >= {WIN_SQL} GROUP BY scope_key)
SELECT scope_key, n, NOT COALESCE(has_reject, FALSE) AS accept_only, n < {C.reliable_metrics_min_samples} AS small_sample_warning,
       NULLIF(concat_ws(' ', CASE WHEN n < {C.reliable_metrics_min_samples}
                                  THEN 'small sample: fewer than {C.reliable_metrics_min_samples} rows; metrics are not reliable.' END,
                        CASE WHEN NOT COALESCE(has_reject, FALSE)
                             THEN 'accept-only feedback: no reject rows in this batch.' END), '') AS metrics_note
FROM a""")
def _accept_only_note(fx):
    return TS.small_sample_notes(_scoped_eligible(fx), by=["scope_key"])


@query("column_profile", """
WITH b AS (SELECT * FROM fx_baseline), n AS (SELECT count(*) AS n FROM b),
p AS (
  SELECT 'animal_type' AS "column", count(*) FILTER (WHERE animal_type IS NULL) AS nulls, count(DISTINCT animal_type) AS nd, TRUE AS txt FROM b
  UNION ALL SELECT 'gender', count(*) FILTER (WHERE gender IS NULL), count(DISTINCT gender), TRUE FROM b
  UNION ALL SELECT 'age_months', count(*) FILTER (WHERE age_months IS NULL), count(DISTINCT age_months), FALSE FROM b
  UNION ALL SELECT 'weight_kg', count(*) FILTER (WHERE weight_kg IS NULL), count(DISTINCT weight_kg), FALSE FROM b
  UNION ALL SELECT 'temperature', count(*) FILTER (WHERE temperature IS NULL), count(DISTINCT temperature), FALSE FROM b
  UNION ALL SELECT 'heart_rate', count(*) FILTER (WHERE heart_rate IS NULL), count(DISTINCT heart_rate), FALSE FROM b
  UNION ALL SELECT 'current_season', count(*) FILTER (WHERE current_season IS NULL), count(DISTINCT current_season), TRUE FROM b
  UNION ALL SELECT 'vaccination_status', count(*) FILTER (WHERE vaccination_status IS NULL), count(DISTINCT vaccination_status), TRUE FROM b
  UNION ALL SELECT 'medical_history', count(*) FILTER (WHERE medical_history IS NULL), count(DISTINCT medical_history), TRUE FROM b
  UNION ALL SELECT 'symptom_duration', count(*) FILTER (WHERE symptom_duration IS NULL), count(DISTINCT symptom_duration), FALSE FROM b
  UNION ALL SELECT 'symptoms_list', count(*) FILTER (WHERE symptoms_list IS NULL), count(DISTINCT symptoms_list), TRUE FROM b)
SELECT "column", CAST(nulls AS DOUBLE) / n AS null_ratio, nd AS distinct_count,
       CASE WHEN CAST(nulls AS DOUBLE) / n > 0.5 THEN 'skipped' WHEN txt THEN 'categorical'
            WHEN nd <= least(20.0, n * 0.05) THEN 'categorical' ELSE 'numeric' END AS kind
FROM p, n""")
def _column_profile(fx):
    return TS.column_profile(fx.baseline, list(FEATURES))


@query("random_split", f"""
WITH {MIX_SQL},
f AS (SELECT *, sha256('{SEED}:' || row_key) AS h FROM frame),
cls AS (SELECT scope_key, label, count(*) AS cn FROM f GROUP BY 1, 2),
st AS (SELECT scope_key, min(cn) AS min_c, count(*) AS k, sum(cn) AS n FROM cls GROUP BY 1),
nb AS (SELECT scope_key, CASE WHEN n < 20 THEN 0.1 WHEN n < 50 THEN 0.15 WHEN n < 200 THEN 0.2 ELSE 0.25 END AS ratio
       FROM st),
r AS (SELECT f.*, row_number() OVER (PARTITION BY f.scope_key, f.label ORDER BY h, row_key) AS rc,
             row_number() OVER (PARTITION BY f.scope_key ORDER BY h, row_key) AS ra FROM f)
SELECT r.scope_key, r.row_key,
       CASE WHEN st.min_c >= 2 AND st.k >= 2 THEN rc <= round_even(cls.cn * nb.ratio, 0)
            ELSE ra <= round_even(st.n * nb.ratio, 0) END AS is_validation,
       st.min_c >= 2 AND st.k >= 2 AS stratified
FROM r JOIN cls ON r.scope_key = cls.scope_key AND r.label = cls.label JOIN st ON r.scope_key = st.scope_key
JOIN nb ON r.scope_key = nb.scope_key""")
def _random_split(fx):
    frame = _frame(fx)
    n = frame.groupBy("scope_key").agg(S.adaptive_split_ratio(F.count(F.lit(1))).cast("double").alias("_ratio_s"))
    f = frame.join(n, "scope_key")
    return TS.random_split(f, F.col("_ratio_s"), SEED, by=["scope_key"]).select(
        "scope_key", "row_key", "is_validation", "stratified")


@query("time_aware_split", f"""
WITH {MIX_SQL},
n AS (SELECT scope_key, count(*) AS n, count(DISTINCT label) AS k FROM frame GROUP BY scope_key),
o AS (SELECT frame.*, row_number() OVER (PARTITION BY scope_key ORDER BY sample_ts, row_key) AS pos FROM frame),
t AS (SELECT scope_key, least(n - 1, greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT))) AS nt, n, k FROM n),
v AS (SELECT o.scope_key, o.row_key, o.label, o.pos > t.n - t.nt AS is_validation, t.n, t.k, t.nt
      FROM o JOIN t ON o.scope_key = t.scope_key),
kv AS (SELECT scope_key, count(DISTINCT label) AS kv FROM v WHERE is_validation GROUP BY scope_key)
SELECT v.scope_key, row_key, is_validation, (n >= 30 AND n - nt >= 1 AND (k < 2 OR COALESCE(kv, 0) >= 2)) AS time_split_ok
FROM v LEFT JOIN kv ON v.scope_key = kv.scope_key""")
def _time_aware_split(fx):
    return TS.time_aware_split(_frame(fx), 0.25, by=["scope_key"]).select(
        "scope_key", "row_key", "is_validation", "time_split_ok")


@query("split_seed", f"""
WITH {SCOPED_SQL}, {BATCHES_SQL},
j AS (SELECT b.scope_key, b.batch_no, f.id, f.created_at, f.prediction_id, f.final_diagnosis
      FROM batches b JOIN fx_feedback f ON b.id = f.id)
SELECT scope_key, batch_no,
       CAST(('0x' || substr(sha256('{SEED}no-training-id' || string_agg(COALESCE(CAST(prediction_id AS VARCHAR), '')
            || lower(trim(COALESCE(final_diagnosis, ''), {WS})) || '|', '' ORDER BY created_at, id)), 1, 8))::UINTEGER
            & 2147483647 AS BIGINT) AS split_seed
FROM j GROUP BY scope_key, batch_no""")
def _split_seed(fx):
    scoped = SC.feedback_scopes(fx.feedback, fx.prediction_log)
    b = ST.watermark_batches(scoped, fx.scope_state, AS_OF, W, BATCH_T).select("scope_key", "batch_no", "id")
    j = b.join(fx.feedback.select("id", "created_at", "prediction_id", "final_diagnosis"), "id")
    return TS.split_seed(j, ["scope_key", "batch_no"], SEED)


@query("batch_idempotency_key", f"""
WITH {SCOPED_SQL}, {BATCHES_SQL}
SELECT scope_key, batch_no, sha256('[' || array_to_string(list_sort(list(id)), ',') || ']') AS idempotency_key
FROM batches GROUP BY scope_key, batch_no""")
def _batch_idempotency_key(fx):
    scoped = SC.feedback_scopes(fx.feedback, fx.prediction_log)
    b = ST.watermark_batches(scoped, fx.scope_state, AS_OF, W, BATCH_T)
    return b.groupBy("scope_key", "batch_no").agg(S.batch_idempotency_key(F.collect_list("id")).alias("idempotency_key"))


@query("adaptive_forest_params", f"""
WITH {MIX_SQL},
n AS (SELECT scope_key, count(*) AS n FROM frame GROUP BY scope_key)
SELECT scope_key, n,
       CAST(CASE WHEN n < 50 THEN 50 WHEN n < 200 THEN 100 WHEN n < 1000 THEN 200 ELSE 300 END AS INTEGER) AS n_estimators,
       CAST(least(CASE WHEN n < 50 THEN 5 WHEN n < 200 THEN 8 ELSE 15 END, 11) AS INTEGER) AS max_depth,
       CAST(CASE WHEN n < 50 THEN 2 WHEN n < 200 THEN 5 ELSE greatest(10, floor(n * 0.02)) END AS INTEGER) AS min_samples_split,
       CAST(CASE WHEN n < 50 THEN 1 WHEN n < 200 THEN 2 ELSE greatest(4, floor(n * 0.01)) END AS INTEGER) AS min_samples_leaf,
       n >= 50 AS bootstrap, {SEED} AS random_state
FROM n""")
def _adaptive_forest_params(fx):
    n = _frame(fx).groupBy("scope_key").agg(F.count(F.lit(1)).alias("n"))
    return n.select("scope_key", "n", *TS.adaptive_forest_params(F.col("n"), F.lit(len(FEATURES))))


@query("adaptive_cv_folds", f"""
WITH {MIX_SQL},
c AS (SELECT scope_key, label, count(*) AS cn FROM frame GROUP BY 1, 2)
SELECT scope_key, CAST(CASE WHEN min(cn) < 2 THEN 1 ELSE greatest(2, least(5, min(cn))) END AS INTEGER) AS cv_folds
FROM c GROUP BY scope_key""")
def _adaptive_cv_folds(fx):
    c = _frame(fx).groupBy("scope_key", "label").agg(F.count(F.lit(1)).alias("cn"))
    return c.groupBy("scope_key").agg(TS.adaptive_cv_folds(F.min("cn")).alias("cv_folds"))
