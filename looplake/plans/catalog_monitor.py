"""Catalog: monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from looplake.config import DEFAULT
from looplake.operators import drift as D
from looplake.operators import jobs as J
from looplake.operators import monitor as M
from looplake.operators import scope as SC
from looplake.plans.catalog_scope import SCOPED_SQL, WIN_SQL
from looplake.plans.registry import query
from looplake.sources.fixtures import AS_OF, AS_OF_SQL, WINDOW_DAYS

C = DEFAULT
HIST = "hist AS (SELECT * FROM fx_monitor_log)"
LAB = "actual IS NOT NULL"
OK = "actual IS NOT NULL AND prediction = actual"
BAD = "actual IS NOT NULL AND prediction <> actual"

METRICS_SQL = f"""
life AS (SELECT count(*) AS total_predictions, count(*) FILTER (WHERE {OK}) AS correct_predictions FROM fx_monitor_log),
ll AS (SELECT ts, event_id FROM fx_monitor_log WHERE {LAB} ORDER BY ts DESC, event_id DESC LIMIT 1),
upto AS (SELECT count(*) AS n FROM fx_monitor_log m, ll WHERE m.ts < ll.ts OR (m.ts = ll.ts AND m.event_id <= ll.event_id)),
{HIST},
h AS (SELECT avg(confidence) AS avg_confidence,
             count(*) FILTER (WHERE ts > {AS_OF_SQL} - INTERVAL 1 HOUR) AS predictions_per_hour,
             count(*) FILTER (WHERE {BAD}) AS w, count(*) FILTER (WHERE {LAB}) AS l FROM hist),
metrics AS (
  SELECT total_predictions, correct_predictions,
         CASE WHEN upto.n = 0 THEN 0.0 ELSE CAST(correct_predictions AS DOUBLE) / upto.n END AS accuracy,
         COALESCE(avg_confidence, 0.0) AS avg_confidence, predictions_per_hour,
         CASE WHEN l > 0 THEN CAST(w AS DOUBLE) / l ELSE 0.0 END AS error_rate
  FROM life, upto, h)"""


@query("monitor_metrics", f"""WITH {METRICS_SQL}
SELECT total_predictions, correct_predictions, accuracy, round(avg_confidence, 9) AS avg_confidence,
       predictions_per_hour, error_rate FROM metrics""")
def _monitor_metrics(fx):
    return M.monitor_metrics(fx.monitor_log, AS_OF).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("confidence_stats", f"""
WITH {HIST}
SELECT min(confidence) AS min, max(confidence) AS max, round(median(confidence), 9) AS median,
       round(COALESCE(stddev_samp(confidence), 0.0), 9) AS std FROM hist""")
def _confidence_stats(fx):
    s = M.confidence_stats(fx.monitor_log)
    return s.withColumn("median", F.round("median", 9)).withColumn("std", F.round("std", 9))


@query("prediction_distribution", f"WITH {HIST} SELECT prediction, count(*) AS n FROM hist GROUP BY prediction")
def _prediction_distribution(fx):
    return M.prediction_distribution(fx.monitor_log)


@query("recent_24h_accuracy", f"""
WITH {HIST}, r AS (SELECT * FROM hist WHERE ts > {AS_OF_SQL} - INTERVAL 24 HOUR)
SELECT CASE WHEN count(*) FILTER (WHERE {LAB}) > 0
            THEN CAST(count(*) FILTER (WHERE {OK}) AS DOUBLE) / count(*) FILTER (WHERE {LAB}) ELSE 0.0 END
         AS recent_24h_accuracy,
       count(*) AS recent_24h_predictions FROM r""")
def _recent_24h_accuracy(fx):
    return M.recent_accuracy(fx.monitor_log, AS_OF, 24)


@query("hourly_trend", f"""
WITH {HIST}, r AS (SELECT * FROM hist WHERE ts > {AS_OF_SQL} - INTERVAL 48 HOUR),
g AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*) AS predictions,
             count(*) FILTER (WHERE {OK}) AS c, count(*) FILTER (WHERE {LAB}) AS l, avg(confidence) AS avg_confidence
      FROM r GROUP BY 1)
SELECT hour, predictions, CASE WHEN l > 0 THEN CAST(c AS DOUBLE) / l ELSE 0.0 END AS accuracy,
       round(avg_confidence, 9) AS avg_confidence,
       1.0 - CASE WHEN l > 0 THEN CAST(c AS DOUBLE) / l ELSE 0.0 END AS error_rate FROM g""")
def _hourly_trend(fx):
    return M.hourly_trend(fx.monitor_log, AS_OF, 48).withColumn("avg_confidence", F.round("avg_confidence", 9))


def _hist_sql(table: str, col: str, bounds, metric: str) -> str:
    parts = [f"SELECT '{metric}' AS metric, '{b}' AS le, count(*) FILTER (WHERE {col} <= {float(b)}) AS bucket_count, "
             f"round(sum({col}), 9) AS sum, count(*) AS count FROM {table} WHERE {col} IS NOT NULL" for b in bounds]
    parts.append(f"SELECT '{metric}', '+Inf', count(*), round(sum({col}), 9), count(*) FROM {table} WHERE {col} IS NOT NULL")
    return "\nUNION ALL ".join(parts)


@query("confidence_histogram", _hist_sql("fx_monitor_log", "confidence", M.CONFIDENCE_BUCKETS, "confidence"))
def _confidence_histogram(fx):
    return M.cumulative_histogram(fx.monitor_log, "confidence", M.CONFIDENCE_BUCKETS).select(
        F.lit("confidence").alias("metric"), "le", "bucket_count", F.round("sum", 9).alias("sum"), "count")


@query("latency_histogram", _hist_sql("fx_monitor_log", "latency_seconds", M.LATENCY_BUCKETS, "inference_latency")
       + "\nUNION ALL " + _hist_sql("(SELECT epoch(end_time) - epoch(start_time) AS d FROM fx_job)", "d",
                                    M.TRAINING_DURATION_BUCKETS, "training_duration"))
def _latency_histogram(fx):
    a = M.cumulative_histogram(fx.monitor_log, "latency_seconds", M.LATENCY_BUCKETS).select(
        F.lit("inference_latency").alias("metric"), "le", "bucket_count", "sum", "count")
    d = fx.job.select((F.unix_micros("end_time") - F.unix_micros("start_time")).cast("double").alias("_us"))
    d = d.select((F.col("_us") / 1e6).alias("d"))
    b = M.cumulative_histogram(d, "d", M.TRAINING_DURATION_BUCKETS).select(
        F.lit("training_duration").alias("metric"), "le", "bucket_count", "sum", "count")
    return a.unionByName(b).withColumn("sum", F.round("sum", 9))


@query("requests_by_clinic_status", """
SELECT COALESCE(clinic_id, 'global') AS clinic_id, CASE WHEN prediction = 'error' THEN 'error' ELSE 'success' END AS status,
       count(*) AS requests FROM fx_monitor_log GROUP BY ALL""")
def _requests_by_clinic_status(fx):
    st = F.when(F.col("prediction") == "error", F.lit("error")).otherwise(F.lit("success"))
    return M.requests_by_clinic_status(fx.monitor_log, st)


BURST_SQL = f"""
seq AS (SELECT *, sum(CASE WHEN {BAD} THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
                  AS recent_errors FROM fx_monitor_log),
burst AS (SELECT event_id, ts, 'high_error_rate' AS type, recent_errors,
                 'High error rate detected: ' || recent_errors || '/10 recent predictions' AS message
          FROM seq WHERE {BAD} AND recent_errors >= 5),
lowc AS (SELECT event_id, ts, prediction, 'low_confidence' AS type, printf('Very low confidence: %.2f', confidence) AS message
         FROM fx_monitor_log WHERE confidence < 0.3)"""


@query("error_burst_alerts", f"WITH {BURST_SQL} SELECT * FROM burst")
def _error_burst_alerts(fx):
    return M.error_burst_alerts(fx.monitor_log)


@query("low_confidence_alerts", f"WITH {BURST_SQL} SELECT * FROM lowc")
def _low_confidence_alerts(fx):
    return M.low_confidence_alerts(fx.monitor_log)


@query("running_monitor", f"""
WITH s AS (
  SELECT event_id, ts,
         row_number() OVER w AS total_predictions,
         sum(CASE WHEN {OK} THEN 1 ELSE 0 END) OVER w AS correct_predictions,
         max(CASE WHEN {LAB} THEN 1 ELSE 0 END * 1) OVER w AS any_lab,
         CAST(sum(CAST(confidence AS DECIMAL(38, 9))) OVER w
              AS DOUBLE) / CAST(count(confidence) OVER w
              AS DOUBLE) AS avg_confidence,
         sum(CASE WHEN {BAD} THEN 1 ELSE 0 END) OVER w AS w,
         sum(CASE WHEN {LAB} THEN 1 ELSE 0 END) OVER w AS l,
         count(*) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS before_hour,
         CASE WHEN {LAB} THEN 1 ELSE 0 END AS is_lab
  FROM fx_monitor_log WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s2 AS (SELECT *, max(CASE WHEN is_lab = 1 THEN total_predictions ELSE 0 END)
                 OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_lab FROM s)
SELECT event_id, ts, total_predictions, correct_predictions,
       CASE WHEN last_lab > 0 THEN CAST(correct_predictions AS DOUBLE) / last_lab ELSE 0.0 END AS accuracy,
       round(avg_confidence, 9) AS avg_confidence, total_predictions - COALESCE(before_hour, 0) AS predictions_per_hour,
       CASE WHEN l > 0 THEN CAST(w AS DOUBLE) / l ELSE 0.0 END AS error_rate
FROM s2""")
def _running_monitor(fx):
    return M.running_monitor(fx.monitor_log)


HEALTH_SQL = f"""
{METRICS_SQL},
checks AS (
  SELECT 'Accuracy Check' AS name, 'warning' AS status, printf('Accuracy %.2f below threshold 0.7', accuracy) AS message
  FROM metrics WHERE accuracy < 0.7
  UNION ALL SELECT 'Confidence Check', 'warning', printf('Average confidence %.2f below threshold 0.6', avg_confidence)
  FROM metrics WHERE avg_confidence < 0.6
  UNION ALL SELECT 'Prediction Volume', 'info', printf('Low prediction volume: %.1f per hour', CAST(predictions_per_hour AS DOUBLE))
  FROM metrics WHERE predictions_per_hour < 1
  UNION ALL SELECT 'Error Rate', 'critical', printf('High error rate: %.2f', error_rate) FROM metrics WHERE error_rate > 0.3
  UNION ALL SELECT 'Error Rate', 'warning', printf('Elevated error rate: %.2f', error_rate) FROM metrics
  WHERE error_rate <= 0.3 AND error_rate > 0.2),
overall AS (SELECT CASE WHEN error_rate > 0.3 THEN 'critical' WHEN error_rate > 0.2 THEN 'warning' ELSE 'healthy' END
                     AS overall_health FROM metrics),
health AS (SELECT overall_health, name, status, message FROM overall LEFT JOIN checks ON TRUE)"""


@query("model_health", f"WITH {HEALTH_SQL} SELECT * FROM health")
def _model_health(fx):
    return M.model_health(M.monitor_metrics(fx.monitor_log, AS_OF))


RETRAIN_SQL = f"""
retrain AS (
  SELECT *, q * 0.3 + p * 0.5 + d * 0.2 AS overall_score, (q * 0.3 + p * 0.5 + d * 0.2) >= 0.6 AND q >= 0.5 AS eligible
  FROM (SELECT total_predictions, accuracy, error_rate, least(1.0, total_predictions / 100.0) AS q,
               CASE WHEN error_rate > 0.3 THEN 0.5 ELSE 1.0 END *
               CASE WHEN accuracy >= 0.7 THEN 1.0 WHEN accuracy > 0.5 THEN (accuracy - 0.5) / (CAST(0.7 AS DOUBLE) - CAST(0.5 AS DOUBLE)) ELSE 0.0 END AS p,
               dd.drift_score AS d
        FROM metrics, dd)),
retrain_out AS (
  SELECT round(q, 9) AS data_quality_score, round(p, 9) AS performance_score, d AS drift_score,
         round(overall_score, 9) AS overall_score, eligible,
         CASE WHEN len(rs) > 0 THEN array_to_string(rs, '; ')
              WHEN eligible THEN 'Model performance meets retraining criteria' ELSE 'Not eligible' END AS reason
  FROM (SELECT *, list_filter([
          CASE WHEN q < 0.5 THEN printf('Insufficient data (%d < 100)', total_predictions) END,
          CASE WHEN accuracy < 0.7 THEN printf('Low accuracy (%.2f < 0.7)', accuracy) END,
          CASE WHEN error_rate > 0.3 THEN printf('High error rate (%.2f > 0.3)', error_rate) END,
          CASE WHEN d > 0.5 THEN 'Data drift detected' END], lambda x: x IS NOT NULL) AS rs FROM retrain))"""

NUM_COLS = D.NUMERIC_DRIFT_COLUMNS
CAT_COLS = D.CATEGORICAL_DRIFT_COLUMNS


def _long_sql(cols, cast):
    return "\nUNION ALL ".join(f"SELECT side, '{c}' AS col, CAST({c} AS {cast}) AS v FROM fx_drift_side" for c in cols)


NUMERIC_DRIFT_SQL = f"""
nlong AS ({_long_sql(NUM_COLS, 'DOUBLE')}),
ncnt AS (SELECT col, v, count(*) FILTER (WHERE side = 'reference') AS cr, count(*) FILTER (WHERE side = 'current') AS cc
         FROM nlong WHERE v IS NOT NULL GROUP BY col, v),
ntot AS (SELECT col, sum(cr) AS n_ref, sum(cc) AS n_cur FROM ncnt GROUP BY col),
necdf AS (SELECT c.col, c.v, abs(sum(cr) OVER w / t.n_ref - sum(cc) OVER w / t.n_cur) AS diff,
                 COALESCE(lead(c.v) OVER w2 - c.v, 0.0) AS dx
          FROM ncnt c JOIN ntot t ON c.col = t.col
          WINDOW w AS (PARTITION BY c.col ORDER BY c.v ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY c.col ORDER BY c.v)),
nks AS (SELECT col, max(diff) AS ks_stat, sum(diff * dx) AS wasserstein FROM necdf GROUP BY col),
nstd AS (SELECT col, stddev_pop(v) AS ref_std FROM nlong WHERE side = 'reference' AND v IS NOT NULL GROUP BY col),
nres0 AS (SELECT k.col AS "column", t.n_ref, t.n_cur, k.ks_stat, k.wasserstein, s.ref_std,
                 (sqrt(t.n_ref * t.n_cur / (t.n_ref + t.n_cur)) + 0.12 + 0.11 / sqrt(t.n_ref * t.n_cur / (t.n_ref + t.n_cur)))
                   * k.ks_stat AS lam
          FROM nks k JOIN ntot t ON k.col = t.col LEFT JOIN nstd s ON k.col = s.col),
nres AS (SELECT "column", n_ref, n_cur, ks_stat,
                CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101),
                  lambda j: 2.0 * (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * lam * lam))))) END AS p_value,
                wasserstein, CASE WHEN ref_std > 0 THEN wasserstein / ref_std ELSE wasserstein END AS wasserstein_norm
         FROM nres0),
numeric_drift AS (SELECT *, wasserstein_norm >= 0.1 AS drift_detected
                  FROM nres)"""


def _cat_sql(cols, prefix):
    return f"""
{prefix}long AS ({_long_sql(cols, 'VARCHAR')}),
{prefix}cnt AS (SELECT col, v, count(*) FILTER (WHERE side = 'reference') AS cr,
                       count(*) FILTER (WHERE side = 'current') AS cc FROM {prefix}long WHERE v IS NOT NULL GROUP BY col, v),
{prefix}tot AS (SELECT col, sum(cr) AS n_ref, sum(cc) AS n_cur, count(*) AS k FROM {prefix}cnt GROUP BY col),
{prefix}cell AS (
  SELECT c.col, t.n_ref, t.n_cur, t.k,
         CASE WHEN er > 0 THEN power(cr - er, 2) / er ELSE 0 END + CASE WHEN ec > 0 THEN power(cc - ec, 2) / ec ELSE 0 END
           AS chi,
         CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END
           AS kl
  FROM (SELECT c.*, t.n_ref * (cr + cc) / (t.n_ref + t.n_cur) AS er, t.n_cur * (cr + cc) / (t.n_ref + t.n_cur) AS ec,
               CAST(cr AS DOUBLE) / t.n_ref AS p, CAST(cc AS DOUBLE) / t.n_cur AS q
        FROM {prefix}cnt c JOIN {prefix}tot t ON c.col = t.col) c JOIN {prefix}tot t ON c.col = t.col),
{prefix}agg AS (SELECT col, any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur, any_value(k) AS k, sum(chi) AS chi2_stat,
                       sqrt(greatest(0.0, sum(kl) / 2.0)) AS js_distance FROM {prefix}cell GROUP BY col),
{prefix}z AS (SELECT *, CAST(k - 1 AS DOUBLE) AS dof,
                     (pow(chi2_stat / (k - 1), 1.0 / 3.0) - (1.0 - 2.0 / (9.0 * (k - 1)))) / sqrt(2.0 / (9.0 * (k - 1))) AS z
              FROM {prefix}agg),
{prefix}res AS (
  SELECT col AS "column", n_ref, n_cur, chi2_stat,
         CASE WHEN dof <= 0 THEN 1.0 ELSE (CASE WHEN z >= 0 THEN tail ELSE 1.0 - tail END) END AS p_value, js_distance
  FROM (SELECT *, exp(-abs(z) * abs(z) / 2.0) / sqrt(2 * pi()) * (1.0 / (1.0 + 0.2316419 * abs(z))) *
                  (0.319381530 + (1.0 / (1.0 + 0.2316419 * abs(z))) * (-0.356563782 + (1.0 / (1.0 + 0.2316419 * abs(z)))
                  * (1.781477937 + (1.0 / (1.0 + 0.2316419 * abs(z))) * (-1.821255978 + (1.0 / (1.0 + 0.2316419 * abs(z)))
                  * 1.330274429)))) AS tail FROM {prefix}z)),
{prefix}drift AS (SELECT *, js_distance >= 0.1 AS drift_detected
                  FROM {prefix}res)"""


def _drift_frames(fx):
    s = fx.drift_side
    return s.where(F.col("side") == "reference"), s.where(F.col("side") == "current")


def _r9(df, cols):
    return df.select(*[F.round(c, 9).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("drift_numeric", f"""WITH {NUMERIC_DRIFT_SQL}
SELECT "column", n_ref, n_cur, round(ks_stat, 9) AS ks_stat, round(p_value, 9) AS p_value,
       round(wasserstein, 9) AS wasserstein, round(wasserstein_norm, 9) AS wasserstein_norm, drift_detected
FROM numeric_drift""")
def _drift_numeric(fx):
    ref, cur = _drift_frames(fx)
    return _r9(D.drift_numeric(ref, cur), {"ks_stat", "p_value", "wasserstein", "wasserstein_norm"})


@query("drift_categorical", f"""WITH {_cat_sql(CAT_COLS, 'c')}
SELECT "column", n_ref, n_cur, round(chi2_stat, 9) AS chi2_stat, round(p_value, 9) AS p_value,
       round(js_distance, 9) AS js_distance, drift_detected FROM cdrift""")
def _drift_categorical(fx):
    ref, cur = _drift_frames(fx)
    return _r9(D.drift_categorical(ref, cur), {"chi2_stat", "p_value", "js_distance"})


DATASET_DRIFT_SQL = f"""{NUMERIC_DRIFT_SQL}, {_cat_sql(CAT_COLS, 'c')},
allcols AS (SELECT drift_detected FROM numeric_drift UNION ALL SELECT drift_detected FROM cdrift),
dd AS (SELECT count(*) AS n_columns, count(*) FILTER (WHERE drift_detected) AS n_drifted,
              CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) AS share_drifted,
              CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) >= 0.5 AS dataset_drift,
              CASE WHEN CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) >= 0.5 THEN 1.0 ELSE 0.0 END
                AS drift_score FROM allcols)"""


def _dataset_drift(fx):
    ref, cur = _drift_frames(fx)
    cols = ["column", "drift_detected"]
    both = D.drift_numeric(ref, cur).select(*cols).unionByName(D.drift_categorical(ref, cur).select(*cols))
    return D.dataset_drift(both)


@query("dataset_drift", f"WITH {DATASET_DRIFT_SQL} SELECT * FROM dd")
def _dataset_drift_q(fx):
    return _dataset_drift(fx)


@query("target_drift", f"""WITH {_cat_sql(('target_diagnosis',), 't')}
SELECT "column", n_ref, n_cur, round(chi2_stat, 9) AS chi2_stat, round(p_value, 9) AS p_value,
       round(js_distance, 9) AS js_distance, drift_detected FROM tdrift""")
def _target_drift(fx):
    ref, cur = _drift_frames(fx)
    return _r9(D.target_drift(ref, cur), {"chi2_stat", "p_value", "js_distance"})


@query("drift_alert_rule", f"""WITH {DATASET_DRIFT_SQL}
SELECT drift_score, CASE WHEN drift_score > 0.5 THEN 'warning' END AS severity,
       CASE WHEN drift_score > 0.5 THEN 'Data drift detected (drift_score > 0.5)' END AS alert_message FROM dd""")
def _drift_alert_rule(fx):
    return M.drift_alert_rule(_dataset_drift(fx).select("drift_score"))


@query("retrain_score", f"WITH {METRICS_SQL}, {DATASET_DRIFT_SQL}, {RETRAIN_SQL} SELECT * FROM retrain_out")
def _retrain_score(fx):
    m = M.monitor_metrics(fx.monitor_log, AS_OF)
    d = _dataset_drift(fx).select("drift_score")
    r = M.retrain_score(m.crossJoin(d), F.col("drift_score"))
    return r.select(*[F.round(c, 9).alias(c) if c in ("data_quality_score", "performance_score", "overall_score")
                      else F.col(c) for c in r.columns])


@query("health_rollup", f"""WITH {HEALTH_SQL}, {DATASET_DRIFT_SQL}, {RETRAIN_SQL},
checks2 AS (SELECT 'Model Performance' AS name, (SELECT overall_health FROM overall) AS status
            UNION ALL SELECT 'Data Drift', CASE WHEN drift_score > 0.5 THEN 'warning' ELSE 'ok' END FROM retrain_out
            UNION ALL SELECT 'Training Eligibility', CASE WHEN eligible THEN 'ready' ELSE 'not_ready' END FROM retrain_out)
SELECT name, status, (SELECT CASE WHEN bool_or(status = 'critical') THEN 'critical'
                                  WHEN bool_or(status IN ('warning', 'critical')) THEN 'warning' ELSE 'healthy' END
                      FROM checks2) AS overall_status FROM checks2""")
def _health_rollup(fx):
    m = M.monitor_metrics(fx.monitor_log, AS_OF)
    h = M.model_health(m)
    r = M.retrain_score(m.crossJoin(_dataset_drift(fx).select("drift_score")), F.col("drift_score"))
    return M.health_rollup(h, r)


@query("alert_counts", f"""WITH {BURST_SQL},
al AS (SELECT event_id FROM burst UNION ALL SELECT event_id FROM lowc)
SELECT count(*) AS active_alerts, count(*) AS total_alerts FROM al""")
def _alert_counts(fx):
    a = M.error_burst_alerts(fx.monitor_log).select("event_id").unionByName(
        M.low_confidence_alerts(fx.monitor_log).select("event_id"))
    return M.alert_counts(a)


@query("recent_tail", f"""
SELECT 'prediction' AS kind, event_id, ts FROM (SELECT * FROM fx_monitor_log ORDER BY ts DESC, event_id DESC LIMIT 100)
UNION ALL
SELECT 'alert', event_id, ts FROM (WITH {BURST_SQL}
  SELECT event_id, ts FROM (SELECT event_id, ts FROM burst UNION ALL SELECT event_id, ts FROM lowc)
  ORDER BY ts DESC, event_id DESC LIMIT 50)""")
def _recent_tail(fx):
    p = M.recent_tail(fx.monitor_log, 100).select(F.lit("prediction").alias("kind"), "event_id", "ts")
    al = M.error_burst_alerts(fx.monitor_log).select("event_id", "ts").unionByName(
        M.low_confidence_alerts(fx.monitor_log).select("event_id", "ts"))
    a = M.recent_tail(al, 50).select(F.lit("alert").alias("kind"), "event_id", "ts")
    return p.unionByName(a)


@query("gauge_table", f"""
WITH {SCOPED_SQL},
e AS (SELECT 'feedback_eligible' AS metric, scope_key AS label,
             count(*) FILTER (WHERE is_training_eligible AND created_at >= {WIN_SQL}) AS value FROM scoped GROUP BY scope_key),
c AS (SELECT 'feedback_by_correct' AS metric, CASE WHEN is_correct THEN 'accept' ELSE 'reject' END AS label, count(*) AS value
      FROM fx_feedback GROUP BY ALL),
s AS (SELECT * FROM (VALUES ('pending'), ('running'), ('completed'), ('failed')) AS t(status)),
j AS (SELECT 'training_jobs' AS metric, s.status AS label, COALESCE(n, 0) AS value
      FROM s LEFT JOIN (SELECT lower(status) AS status, count(*) AS n FROM fx_job GROUP BY 1) c ON s.status = c.status)
SELECT * FROM e UNION ALL SELECT * FROM c UNION ALL SELECT * FROM j""")
def _gauge_table(fx):
    counts = SC.feedback_counts(SC.feedback_scopes(fx.feedback, fx.prediction_log), AS_OF, WINDOW_DAYS)
    e = counts.select(F.lit("feedback_eligible").alias("metric"), F.col("scope_key").alias("label"),
                      F.col("eligible_in_window").alias("value"))
    c = SC.feedback_by_correct(fx.feedback).select(
        F.lit("feedback_by_correct").alias("metric"),
        F.when(F.col("is_correct"), F.lit("accept")).otherwise(F.lit("reject")).alias("label"), F.col("n").alias("value"))
    j = J.jobs_by_status(fx.job).select(F.lit("training_jobs").alias("metric"), F.col("status").alias("label"),
                                        F.col("job_count").alias("value"))
    return e.unionByName(c).unionByName(j)


@query("drift_windows", f"""
WITH cur AS (SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start,
                    CAST(json_extract(prediction_input, '$.temperature') AS DOUBLE) AS temperature,
                    CAST(json_extract(prediction_input, '$.weight_kg') AS DOUBLE) AS weight_kg,
                    CAST(json_extract(prediction_input, '$.heart_rate') AS DOUBLE) AS heart_rate,
                    CAST(json_extract(prediction_input, '$.age_months') AS DOUBLE) AS age_months
             FROM fx_prediction_log),
clong AS ({" UNION ALL ".join(f"SELECT window_start, '{c}' AS col, {c} AS v FROM cur" for c in NUM_COLS)}),
rlong AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM fx_baseline" for c in NUM_COLS)}),
cc AS (SELECT window_start, col, v, count(*) AS cc FROM clong WHERE v IS NOT NULL GROUP BY ALL),
rc AS (SELECT col, v, count(*) AS cr FROM rlong WHERE v IS NOT NULL GROUP BY ALL),
w AS (SELECT DISTINCT window_start FROM cc),
cnt AS (SELECT COALESCE(a.window_start, b.window_start) AS window_start, COALESCE(a.col, b.col) AS col,
               COALESCE(a.v, b.v) AS v, COALESCE(a.cr, 0) AS cr, COALESCE(b.cc, 0) AS cc
        FROM (SELECT * FROM w CROSS JOIN rc) a FULL OUTER JOIN cc b
          ON a.window_start = b.window_start AND a.col = b.col AND a.v = b.v),
tot AS (SELECT window_start, col, sum(cr) AS n_ref, sum(cc) AS n_cur FROM cnt GROUP BY ALL),
e AS (SELECT c.window_start, c.col, abs(sum(cr) OVER x / t.n_ref - sum(cc) OVER x / t.n_cur) AS diff,
             COALESCE(lead(c.v) OVER y - c.v, 0.0) AS dx
      FROM cnt c JOIN tot t ON c.window_start = t.window_start AND c.col = t.col
      WINDOW x AS (PARTITION BY c.window_start, c.col ORDER BY c.v ROWS UNBOUNDED PRECEDING),
             y AS (PARTITION BY c.window_start, c.col ORDER BY c.v)),
k AS (SELECT window_start, col, max(diff) AS ks_stat, sum(diff * dx) AS wasserstein FROM e GROUP BY ALL)
SELECT k.window_start, k.col AS "column", t.n_ref, t.n_cur, round(k.ks_stat, 9) AS ks_stat,
       round(k.wasserstein, 9) AS wasserstein
FROM k JOIN tot t ON k.window_start = t.window_start AND k.col = t.col""")
def _drift_windows(fx):
    cur = SC.extract_features(fx.prediction_log, keep=("created_at",))
    r = D.drift_windows(fx.baseline, cur, "created_at")
    return r.select("window_start", "column", "n_ref", "n_cur", F.round("ks_stat", 9).alias("ks_stat"),
                    F.round("wasserstein", 9).alias("wasserstein"))


@query("monitor_export")
def _monitor_export(fx):
    """One JSON document: metrics, 24 h trend, health, last 100 predictions, last 50 alerts."""
    log = fx.monitor_log
    m = M.monitor_metrics(log, AS_OF)
    trend = M.hourly_trend(log, AS_OF, 24).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("performance_trend"))
    health = M.model_health(m).agg(F.first("overall_health").alias("overall_health"),
                                   F.collect_list(F.struct("name", "status", "message")).alias("checks"))
    recent = M.recent_tail(log, 100).agg(F.collect_list(F.struct("event_id", "prediction", "confidence", "ts"))
                                         .alias("recent_predictions"))
    al = M.error_burst_alerts(log).select("event_id", "ts", "type", "message").unionByName(
        M.low_confidence_alerts(log).select("event_id", "ts", "type", "message"))
    alerts = M.recent_tail(al, 50).agg(F.collect_list(F.struct("*")).alias("alerts"))
    doc = m.crossJoin(trend).crossJoin(health).crossJoin(recent).crossJoin(alerts)
    return doc.select(F.to_json(F.struct("*")).alias("document"))


@query("mlops_status", f"""WITH {HEALTH_SQL}, {DATASET_DRIFT_SQL}, {RETRAIN_SQL},
tr AS (SELECT count(DISTINCT date_trunc('hour', ts)) AS trend_hours FROM hist WHERE ts > {AS_OF_SQL} - INTERVAL 24 HOUR)
SELECT m.total_predictions, m.correct_predictions, m.accuracy, round(m.avg_confidence, 9) AS avg_confidence,
       m.predictions_per_hour, m.error_rate, (SELECT overall_health FROM overall) AS overall_health,
       r.data_quality_score, r.performance_score, r.drift_score, r.overall_score, r.eligible, r.reason, tr.trend_hours
FROM metrics m, retrain_out r, tr""")
def _mlops_status(fx):
    """Metrics + health + eligibility + trend as one row."""
    log = fx.monitor_log
    m = M.monitor_metrics(log, AS_OF)
    h = M.model_health(m).agg(F.first("overall_health").alias("overall_health"))
    r = M.retrain_score(m.crossJoin(_dataset_drift(fx).select("drift_score")), F.col("drift_score"))
    r = r.select(*[F.round(c, 9).alias(c) if c in ("data_quality_score", "performance_score", "overall_score")
                   else F.col(c) for c in r.columns])
    t = M.hourly_trend(log, AS_OF, 24).agg(F.count(F.lit(1)).alias("trend_hours"))
    out = m.withColumn("avg_confidence", F.round("avg_confidence", 9)).crossJoin(h).crossJoin(r).crossJoin(t)
    return out
