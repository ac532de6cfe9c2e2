"""Catalog: Structured Streaming keys.

Each key writes fixture rows as files (in arrival order) into a fresh folder under the
shared checkpoint directory, runs the stream with ``Trigger.AvailableNow`` and returns what
the sink holds at the end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from looplake.operators import scope as SC
from looplake.plans.catalog_scope import SCOPED_SQL
from looplake.plans.catalog_state import FB_CHANGES
from looplake.plans.registry import query
from looplake.sources.fixtures import AS_OF, AS_OF_SQL, BATCH_T
from looplake.streaming import streams as STR


def _monitor_source(fx, path: str, late_rows: bool = True) -> str:
    log = fx.monitor_log
    STR.write_files(log, path, 4, "event_id")
    if late_rows:
        # five copies of the earliest events arrive last (late data for the watermark)
        mx = log.agg(F.max("event_id").alias("_mx"))
        late = (log.orderBy("ts", "event_id").limit(5).crossJoin(mx)
                .withColumn("event_id", F.col("event_id") + F.col("_mx") + 1).drop("_mx"))
        late.coalesce(1).write.mode("append").parquet(path)
    return path


@query("stream_hourly_metrics", """
WITH g AS (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
                  count(*) AS predictions, count(*) FILTER (WHERE actual IS NOT NULL AND prediction = actual) AS c,
                  count(*) FILTER (WHERE actual IS NOT NULL) AS l, avg(confidence) AS avg_confidence
           FROM fx_monitor_log GROUP BY 1, 2)
SELECT window_start, window_end, predictions, CASE WHEN l > 0 THEN CAST(c AS DOUBLE) / l ELSE 0.0 END AS accuracy,
       round(avg_confidence, 9) AS avg_confidence
FROM g""")
def _stream_hourly_metrics(fx):
    p = STR.scratch(fx.spark, "hourly")
    _monitor_source(fx, p["source"])
    out = STR.hourly_metrics_stream(fx.spark, p["source"], p["sink"], p["checkpoint"])
    return out.withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("stream_error_burst", """
WITH m AS (SELECT *, COALESCE(clinic_id, 'global') AS monitor_key,
                  CASE WHEN actual IS NOT NULL AND prediction <> actual THEN 1 ELSE 0 END AS w FROM fx_monitor_log),
s AS (SELECT *, sum(w) OVER (PARTITION BY monitor_key ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n
      FROM m)
SELECT monitor_key, event_id, ts, CAST(n AS INTEGER) AS recent_errors FROM s WHERE w = 1 AND n >= 5""")
def _stream_error_burst(fx):
    """Error-burst alerts from the tails of all monitor keys; files arrive in
    event-id (= time) order, so the result equals a per-key window over (ts, event_id)."""
    p = STR.scratch(fx.spark, "burst")
    _monitor_source(fx, p["source"], late_rows=False)
    return STR.error_burst_stream(fx.spark, p["source"], p["sink"], p["checkpoint"])


@query("stream_auto_trigger", f"""
WITH {SCOPED_SQL},
e AS (SELECT s.scope_key, s.id, row_number() OVER (PARTITION BY s.scope_key ORDER BY s.id) AS pos
      FROM scoped s LEFT JOIN fx_scope_state st ON s.scope_key = st.scope_key
      WHERE COALESCE(s.is_training_eligible, TRUE) AND s.id > COALESCE(st.last_processed_feedback_id, 0)
        AND (st.cooldown_until IS NULL OR st.cooldown_until <= {AS_OF_SQL})),
g AS (SELECT scope_key, CAST(floor((pos - 1) / {BATCH_T}) AS INTEGER) AS bn, list(id ORDER BY id) AS ids
      FROM e GROUP BY 1, 2)
SELECT scope_key, ids[1] AS batch_start_feedback_id, ids[len(ids)] AS batch_end_feedback_id,
       array_to_string(ids, ',') AS batch_ids, sha256('[' || array_to_string(ids, ',') || ']') AS idempotency_key
FROM g WHERE len(ids) = {BATCH_T}""")
def _stream_auto_trigger(fx):
    """Automatic batch requests per scope from keyed state over the feedback stream.  Scopes start after the
    watermark of the scope-state table (0 without a row); those in cooldown at the as-of time wait."""
    p = STR.scratch(fx.spark, "trigger")
    scoped = SC.feedback_scopes(fx.feedback, fx.prediction_log).select(
        "scope_key", "id", "is_training_eligible", "created_at")
    STR.write_files(scoped, p["source"], 4, "id")
    return STR.auto_trigger_stream(fx.spark, p["source"], p["sink"], p["checkpoint"], start=fx.scope_state, now=F.lit(AS_OF))


@query("stream_upsert_feedback", f"""
WITH ch AS ({FB_CHANGES}),
latest AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY prediction_id ORDER BY seq DESC) = 1)
SELECT COALESCE(o.id, n.id) AS id, COALESCE(o.prediction_id, n.prediction_id) AS prediction_id,
       CASE WHEN n.prediction_id IS NOT NULL THEN n.final_diagnosis ELSE o.final_diagnosis END AS final_diagnosis,
       CASE WHEN n.prediction_id IS NOT NULL THEN {AS_OF_SQL} ELSE o.created_at END AS created_at
FROM fx_feedback o FULL OUTER JOIN latest n ON o.prediction_id = n.prediction_id""")
def _stream_upsert_feedback(fx):
    p = STR.scratch(fx.spark, "upsert")
    ch = fx.derive(FB_CHANGES)
    STR.write_files(ch.where(F.col("seq") == 1), p["source"], 3, "id")
    ch.where(F.col("seq") == 2).coalesce(1).write.mode("append").parquet(p["source"])
    out = STR.upsert_feedback_stream(fx.spark, p["source"], ch.schema, p["target"], fx.feedback, p["checkpoint"],
                                     AS_OF)
    return out.select("id", "prediction_id", "final_diagnosis", "created_at")


_STREAM_DRIFT_SQL = """
WITH cur AS (SELECT CAST(id AS BIGINT) AS o, CAST(json_extract(prediction_input, '$.temperature') AS DOUBLE) AS temperature, CAST(json_extract(prediction_input, '$.weight_kg') AS DOUBLE) AS weight_kg, CAST(json_extract(prediction_input, '$.heart_rate') AS DOUBLE) AS heart_rate, CAST(json_extract(prediction_input, '$.age_months') AS DOUBLE) AS age_months FROM fx_prediction_log),
b AS (SELECT min(o) AS lo, max(o) AS hi FROM cur),
cb AS (SELECT least(2, CAST(floor((o - lo) / (CAST(hi - lo + 1 AS DOUBLE) / 3)) AS INTEGER)) AS batch_id, cur.*
       FROM cur, b),
clong AS (SELECT batch_id, 'temperature' AS col, temperature AS v FROM cb UNION ALL SELECT batch_id, 'weight_kg' AS col, weight_kg AS v FROM cb UNION ALL SELECT batch_id, 'heart_rate' AS col, heart_rate AS v FROM cb UNION ALL SELECT batch_id, 'age_months' AS col, age_months AS v FROM cb),
rlong AS (SELECT 'temperature' AS col, CAST(temperature AS DOUBLE) AS v FROM fx_baseline UNION ALL SELECT 'weight_kg' AS col, CAST(weight_kg AS DOUBLE) AS v FROM fx_baseline UNION ALL SELECT 'heart_rate' AS col, CAST(heart_rate AS DOUBLE) AS v FROM fx_baseline UNION ALL SELECT 'age_months' AS col, CAST(age_months AS DOUBLE) AS v FROM fx_baseline),
ccn AS (SELECT batch_id, col, v, count(*) AS cc FROM clong WHERE v IS NOT NULL GROUP BY ALL),
rcn AS (SELECT col, v, count(*) AS cr FROM rlong WHERE v IS NOT NULL GROUP BY ALL),
bw AS (SELECT DISTINCT batch_id FROM ccn),
cnt AS (SELECT COALESCE(a.batch_id, x.batch_id) AS batch_id, COALESCE(a.col, x.col) AS col, COALESCE(a.v, x.v) AS v,
               COALESCE(a.cr, 0) AS cr, COALESCE(x.cc, 0) AS cc
        FROM (SELECT * FROM bw CROSS JOIN rcn) a FULL OUTER JOIN ccn x
          ON a.batch_id = x.batch_id AND a.col = x.col AND a.v = x.v),
tot AS (SELECT batch_id, col, sum(cr) AS n_ref, sum(cc) AS n_cur FROM cnt GROUP BY ALL),
e AS (SELECT c.batch_id, c.col, abs(sum(cr) OVER x / t.n_ref - sum(cc) OVER x / t.n_cur) AS diff,
             COALESCE(lead(c.v) OVER y - c.v, 0.0) AS dx
      FROM cnt c JOIN tot t ON c.batch_id = t.batch_id AND c.col = t.col
      WINDOW x AS (PARTITION BY c.batch_id, c.col ORDER BY c.v ROWS UNBOUNDED PRECEDING),
             y AS (PARTITION BY c.batch_id, c.col ORDER BY c.v)),
k AS (SELECT batch_id, col, max(diff) AS ks_stat, sum(diff * dx) AS wasserstein FROM e GROUP BY ALL),
rs AS (SELECT col, stddev_pop(v) AS ref_std FROM rlong WHERE v IS NOT NULL GROUP BY col),
r0 AS (SELECT k.batch_id, k.col, t.n_ref, t.n_cur, k.ks_stat, k.wasserstein, rs.ref_std,
              (sqrt(t.n_ref * t.n_cur / (t.n_ref + t.n_cur)) + 0.12 + 0.11 / sqrt(t.n_ref * t.n_cur / (t.n_ref + t.n_cur)))
                * k.ks_stat AS lam
       FROM k JOIN tot t ON k.batch_id = t.batch_id AND k.col = t.col JOIN rs ON k.col = rs.col),
r1 AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101),
                   lambda j: 2.0 * (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * lam * lam))))) END
                   AS p_value,
              CASE WHEN ref_std > 0 THEN wasserstein / ref_std ELSE wasserstein END AS wasserstein_norm FROM r0)
SELECT col AS "column", n_ref, n_cur, round(ks_stat, 9) AS ks_stat, round(p_value, 9) AS p_value,
       round(wasserstein, 9) AS wasserstein, round(wasserstein_norm, 9) AS wasserstein_norm,
       wasserstein_norm >= 0.1 AS drift_detected,
       batch_id
FROM r1"""


@query("stream_drift", _STREAM_DRIFT_SQL)
def _stream_drift(fx):
    """Numeric drift of each micro-batch of logged prediction features against the baseline
    (files arrive in id ranges, one file per micro-batch)."""
    p = STR.scratch(fx.spark, "drift")
    cur = SC.extract_features(fx.prediction_log, keep=("id",)).withColumn("_o", F.col("id").cast("long"))
    STR.write_files(cur, p["source"], 3, "_o")
    out = STR.drift_stream(fx.spark, p["source"], cur.schema, fx.baseline, p["sink"], p["checkpoint"])
    return out.select("column", "n_ref", "n_cur", *[F.round(c, 9).alias(c) for c in
                                                     ("ks_stat", "p_value", "wasserstein", "wasserstein_norm")],
                      "drift_detected", F.col("batch_id").cast("int").alias("batch_id"))
