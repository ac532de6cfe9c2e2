"""Catalog: upserts/state, windows (§2.6), top-k (§2.7) and job counts (§2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from looplake.config import DEFAULT
from looplake.functions import scalars as S
from looplake.operators import jobs as J
from looplake.operators import scope as SC
from looplake.operators import state as ST
from looplake.plans.catalog_scope import SCOPED_SQL, WIN_SQL, blank_null_sql
from looplake.plans.registry import query
from looplake.sources.fixtures import AS_OF, AS_OF_SQL, BATCH_T, WINDOW_DAYS

W, T = WINDOW_DAYS, BATCH_T

# ----------------------------------------------------------------- change sets (portable SQL)
PRED_CHANGES = f"""
SELECT CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN id || '-n' ELSE id END AS id, visit_id, pet_id,
       CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN CAST(NULL AS STRING) ELSE 'clinic-new' END AS clinic_id,
       'v9.0' AS model_version, confidence_score, veterinarian_id, prediction_input, prediction_output,
       top_k_predictions, {AS_OF_SQL} AS created_at, 1 AS seq
FROM fx_prediction_log
UNION ALL
SELECT id, visit_id, pet_id, CAST(NULL AS STRING) AS clinic_id, 'v9.1' AS model_version, confidence_score,
       veterinarian_id, prediction_input, prediction_output, top_k_predictions, {AS_OF_SQL} AS created_at, 2 AS seq
FROM fx_prediction_log WHERE CAST(id AS BIGINT) % 4 = 1"""

FB_CHANGES = """
SELECT id + 100000000 AS id,
       CASE WHEN id % 2 = 0 THEN prediction_id ELSE 'n' || prediction_id END AS prediction_id,
       'revised' AS final_diagnosis, is_correct, ai_diagnosis, confidence_rating, is_training_eligible,
       data_quality_score, training_pool, created_at, 1 AS seq
FROM fx_feedback
UNION ALL
SELECT id + 200000000 AS id, prediction_id, 'revised-again' AS final_diagnosis, is_correct, ai_diagnosis,
       confidence_rating, is_training_eligible, data_quality_score, training_pool, created_at, 2 AS seq
FROM fx_feedback WHERE id % 6 = 0"""

POLICY_CHANGES = """
SELECT DISTINCT trim(clinic_id) AS clinic_id,
       CASE WHEN right(trim(clinic_id), 1) IN ('0', '2', '4') THEN 'global' ELSE 'clinic_only' END AS feedback_pool,
       1 AS seq
FROM fx_prediction_log WHERE clinic_id IS NOT NULL AND trim(clinic_id) <> ''"""

JOB_EVENTS = """
SELECT training_id, 1 AS seq, 'running' AS status, start_time, CAST(NULL AS TIMESTAMP) AS end_time,
       CAST(NULL AS STRING) AS new_model_version, CAST(NULL AS DOUBLE) AS f1_score,
       CAST(NULL AS BOOLEAN) AS is_deployed, CAST(NULL AS STRING) AS error_message
FROM fx_job
UNION ALL
SELECT training_id, 2 AS seq, CASE WHEN status IN ('completed', 'failed') THEN status END AS status,
       CAST(NULL AS TIMESTAMP) AS start_time, end_time, new_model_version,
       CASE WHEN status = 'completed' THEN validation_f1 END AS f1_score,
       CASE WHEN status IN ('completed', 'failed') THEN is_deployed END AS is_deployed,
       CASE WHEN status = 'failed' THEN repeat('e', 4100) END AS error_message
FROM fx_job"""

BATCHES_SQL = f"""
mx AS (SELECT scope_key, COALESCE(max(id), 0) AS max_id FROM scoped GROUP BY scope_key),
wm AS (SELECT m.scope_key, COALESCE(s.last_processed_feedback_id, m.max_id) AS wm
       FROM mx m LEFT JOIN fx_scope_state s ON m.scope_key = s.scope_key),
cand AS (SELECT sc.scope_key, sc.scope_clinic, sc.id FROM scoped sc JOIN wm ON sc.scope_key = wm.scope_key
         WHERE sc.is_training_eligible AND sc.created_at >= {WIN_SQL} AND sc.id > wm.wm),
num AS (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY id) AS pos FROM cand),
bt AS (SELECT *, CAST(floor((pos - 1) / {T}) AS INTEGER) AS batch_no FROM num),
sz AS (SELECT scope_key, batch_no, count(*) AS n FROM bt GROUP BY scope_key, batch_no),
batches AS (SELECT bt.* FROM bt JOIN sz ON bt.scope_key = sz.scope_key AND bt.batch_no = sz.batch_no
            WHERE sz.n = {T})"""


def _batches(fx):
    scoped = SC.feedback_scopes(fx.feedback, fx.prediction_log)
    return ST.watermark_batches(scoped, fx.scope_state, AS_OF, W, T)


# ----------------------------------------------------------------- UPS
@query("upsert_predictions", f"""
WITH ch AS ({PRED_CHANGES}),
latest AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT COALESCE(o.id, n.id) AS id,
       CASE WHEN n.id IS NOT NULL THEN COALESCE(n.clinic_id, o.clinic_id) ELSE o.clinic_id END AS clinic_id,
       CASE WHEN n.id IS NOT NULL THEN n.model_version ELSE o.model_version END AS model_version,
       COALESCE(o.created_at, n.created_at) AS created_at
FROM fx_prediction_log o FULL OUTER JOIN latest n ON o.id = n.id""")
def _upsert_predictions(fx):
    ch = fx.derive(PRED_CHANGES)
    return ST.upsert_predictions(fx.prediction_log, ch).select("id", "clinic_id", "model_version", "created_at")


@query("upsert_feedback", f"""
WITH ch AS ({FB_CHANGES}),
latest AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY prediction_id ORDER BY seq DESC) = 1)
SELECT COALESCE(o.id, n.id) AS id, COALESCE(o.prediction_id, n.prediction_id) AS prediction_id,
       CASE WHEN n.prediction_id IS NOT NULL THEN n.final_diagnosis ELSE o.final_diagnosis END AS final_diagnosis,
       CASE WHEN n.prediction_id IS NOT NULL THEN {AS_OF_SQL} ELSE o.created_at END AS created_at
FROM fx_feedback o FULL OUTER JOIN latest n ON o.prediction_id = n.prediction_id""")
def _upsert_feedback(fx):
    ch = fx.derive(FB_CHANGES)
    return ST.upsert_feedback(fx.feedback, ch, AS_OF).select("id", "prediction_id", "final_diagnosis", "created_at")


@query("dedup_feedback", f"""
WITH allfb AS (SELECT id, prediction_id, final_diagnosis FROM fx_feedback
               UNION ALL SELECT id, prediction_id, final_diagnosis FROM ({FB_CHANGES}))
SELECT id, prediction_id, final_diagnosis FROM allfb
QUALIFY row_number() OVER (PARTITION BY prediction_id ORDER BY id DESC) = 1""")
def _dedup_feedback(fx):
    allfb = fx.feedback.select("id", "prediction_id", "final_diagnosis").unionByName(
        fx.derive(FB_CHANGES).select("id", "prediction_id", "final_diagnosis"))
    return ST.dedup_feedback(allfb)


@query("upsert_policy", f"""
WITH ch AS ({POLICY_CHANGES}),
latest AS (SELECT clinic_id, upper(feedback_pool) AS feedback_pool FROM ch)
SELECT clinic_id, feedback_pool, CAST(NULL AS TIMESTAMP) AS updated_at FROM fx_policy
WHERE clinic_id NOT IN (SELECT clinic_id FROM latest)
UNION ALL SELECT clinic_id, feedback_pool, {AS_OF_SQL} FROM latest""")
def _upsert_policy(fx):
    return ST.upsert_policy(fx.policy, fx.derive(POLICY_CHANGES), AS_OF)


def _scope_member_sql(clinic: str | None) -> str:
    if clinic is None:
        return "(training_pool = 'GLOBAL')"
    return (f"(training_pool = 'CLINIC_ONLY' AND prediction_id IN "
            f"(SELECT id FROM fx_prediction_log WHERE clinic_id = '{clinic}'))")


@query("consume_scope", f"""
SELECT 'global' AS scope, id,
       CASE WHEN {_scope_member_sql(None)} AND is_training_eligible THEN FALSE ELSE is_training_eligible END
         AS is_training_eligible,
       COALESCE({_scope_member_sql(None)} AND is_training_eligible, FALSE) AS consumed
FROM fx_feedback
UNION ALL
SELECT 'clinic-2', id,
       CASE WHEN {_scope_member_sql('clinic-2')} AND is_training_eligible THEN FALSE ELSE is_training_eligible END,
       COALESCE({_scope_member_sql('clinic-2')} AND is_training_eligible, FALSE)
FROM fx_feedback""")
def _consume_scope(fx):
    g = ST.consume_scope(fx.feedback, fx.prediction_log, None).select(
        F.lit("global").alias("scope"), "id", "is_training_eligible", "consumed")
    c = ST.consume_scope(fx.feedback, fx.prediction_log, "clinic-2").select(
        F.lit("clinic-2").alias("scope"), "id", "is_training_eligible", "consumed")
    return g.unionByName(c)


@query("consume_batch", f"""
WITH {SCOPED_SQL}, {BATCHES_SQL},
b AS (SELECT id FROM batches WHERE scope_key = 'clinic:clinic-2:CLINIC_ONLY' AND batch_no = 0)
SELECT id, CASE WHEN {_scope_member_sql('clinic-2')} AND is_training_eligible AND id IN (SELECT id FROM b)
                THEN FALSE ELSE is_training_eligible END AS is_training_eligible,
       COALESCE({_scope_member_sql('clinic-2')} AND is_training_eligible AND id IN (SELECT id FROM b), FALSE)
         AS consumed
FROM fx_feedback""")
def _consume_batch(fx):
    b = _batches(fx).where((F.col("scope_key") == "clinic:clinic-2:CLINIC_ONLY") & (F.col("batch_no") == 0))
    return ST.consume_batch(fx.feedback, fx.prediction_log, "clinic-2", b.select("id")).select(
        "id", "is_training_eligible", "consumed")


@query("clear_scope", f"""
SELECT 'global' AS scope, id FROM fx_feedback WHERE NOT COALESCE({_scope_member_sql(None)}, FALSE)
UNION ALL
SELECT 'clinic-2', id FROM fx_feedback WHERE NOT COALESCE({_scope_member_sql('clinic-2')}, FALSE)""")
def _clear_scope(fx):
    g = ST.clear_scope(fx.feedback, fx.prediction_log, None).select(F.lit("global").alias("scope"), "id")
    c = ST.clear_scope(fx.feedback, fx.prediction_log, "clinic-2").select(F.lit("clinic-2").alias("scope"), "id")
    return g.unionByName(c)


@query("clear_all", """
SELECT (SELECT count(*) FROM fx_prediction_log) AS predictions, (SELECT count(*) FROM fx_feedback) AS feedback""")
def _clear_all(fx):
    return ST.clear_all(fx.prediction_log, fx.feedback)


@query("purge_jobs", """
SELECT 'only_global' AS mode, training_id FROM fx_job WHERE clinic_id IS NOT NULL
UNION ALL SELECT 'clinic', training_id FROM fx_job WHERE clinic_id IS DISTINCT FROM 'clinic-3'
UNION ALL SELECT 'one', training_id FROM fx_job WHERE training_id <> 7""")
def _purge_jobs(fx):
    j = fx.job
    a = ST.purge_jobs(j, only_global=True).select(F.lit("only_global").alias("mode"), "training_id")
    b = ST.purge_jobs(j, clinic_id="clinic-3").select(F.lit("clinic").alias("mode"), "training_id")
    c = ST.purge_jobs(j, training_id=7).select(F.lit("one").alias("mode"), "training_id")
    return a.unionByName(b).unionByName(c)


@query("job_lifecycle", f"""
WITH ev AS ({JOB_EVENTS})
SELECT training_id,
       arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
       arg_max(start_time, seq) FILTER (WHERE start_time IS NOT NULL) AS start_time,
       arg_max(end_time, seq) FILTER (WHERE end_time IS NOT NULL) AS end_time,
       arg_max(new_model_version, seq) FILTER (WHERE new_model_version IS NOT NULL) AS new_model_version,
       arg_max(f1_score, seq) FILTER (WHERE f1_score IS NOT NULL) AS f1_score,
       arg_max(is_deployed, seq) FILTER (WHERE is_deployed IS NOT NULL) AS is_deployed,
       length(arg_max(error_message, seq) FILTER (WHERE error_message IS NOT NULL)) AS error_len,
       max(seq) AS last_seq
FROM ev GROUP BY training_id""")
def _job_lifecycle(fx):
    ev = fx.derive(JOB_EVENTS)
    return ST.job_lifecycle(ev).select("training_id", "status", "start_time", "end_time", "new_model_version",
                                       "f1_score", "is_deployed", F.length("error_message").alias("error_len"),
                                       "last_seq")


@query("job_timeout", f"""
SELECT training_id,
       CASE WHEN status = 'running' AND start_time < {AS_OF_SQL} - INTERVAL 300 SECOND THEN 'failed' ELSE status END
         AS status,
       COALESCE(status = 'running' AND start_time < {AS_OF_SQL} - INTERVAL 300 SECOND, FALSE) AS timed_out,
       CASE WHEN status = 'running' AND start_time < {AS_OF_SQL} - INTERVAL 300 SECOND
            THEN 'Training timeout after 5 minutes' END AS error_message
FROM fx_job""")
def _job_timeout(fx):
    return ST.job_timeout(fx.job, AS_OF).select("training_id", "status", "timed_out", "error_message")


@query("scope_state_success", f"""
WITH {SCOPED_SQL}, {BATCHES_SQL},
s AS (SELECT scope_key, max(id) AS wm FROM batches WHERE batch_no = 0 GROUP BY scope_key)
SELECT st.scope_key,
       CAST(CASE WHEN s.wm IS NOT NULL THEN s.wm ELSE st.last_processed_feedback_id END AS BIGINT)
         AS last_processed_feedback_id,
       CASE WHEN s.wm IS NOT NULL THEN NULL ELSE st.cooldown_until END AS cooldown_until,
       CAST(CASE WHEN s.wm IS NOT NULL THEN 0 ELSE st.consecutive_failures END AS INTEGER) AS consecutive_failures
FROM fx_scope_state st LEFT JOIN s ON st.scope_key = s.scope_key""")
def _scope_state_success(fx):
    b = _batches(fx).where(F.col("batch_no") == 0).select("scope_key", F.col("id").alias("last_feedback_id"))
    return ST.scope_state_success(fx.scope_state, b, AS_OF)


_JOB_SCOPE_SQL = (f"CASE WHEN {blank_null_sql('clinic_id')} IS NULL THEN 'global:GLOBAL' "
                  f"ELSE 'clinic:' || {blank_null_sql('clinic_id')} || ':CLINIC_ONLY' END")


@query("scope_state_failure", f"""
WITH f AS (SELECT DISTINCT {_JOB_SCOPE_SQL} AS scope_key FROM fx_job WHERE status = 'failed'),
j AS (SELECT COALESCE(st.scope_key, f.scope_key) AS scope_key, st.last_processed_feedback_id, st.cooldown_until,
             st.consecutive_failures, f.scope_key IS NOT NULL AS hit
      FROM fx_scope_state st FULL OUTER JOIN f ON st.scope_key = f.scope_key)
SELECT scope_key, CAST(COALESCE(last_processed_feedback_id, 0) AS BIGINT) AS last_processed_feedback_id,
       CASE WHEN hit THEN {AS_OF_SQL} + to_seconds(CAST(least(900, 30 * pow(2, least(COALESCE(consecutive_failures, 0) + 1, 5)))
            AS BIGINT)) ELSE cooldown_until END AS cooldown_until,
       CAST(CASE WHEN hit THEN COALESCE(consecutive_failures, 0) + 1 ELSE consecutive_failures END AS INTEGER)
         AS consecutive_failures
FROM j""")
def _scope_state_failure(fx):
    f = fx.job.where(F.col("status") == "failed").select(J.job_scope_key().alias("scope_key"))
    return ST.scope_state_failure(fx.scope_state, f, AS_OF)


@query("scope_state_init", f"""
WITH {SCOPED_SQL},
mx AS (SELECT scope_key, CAST(COALESCE(max(id), 0) AS BIGINT) AS last_processed_feedback_id FROM scoped
       GROUP BY scope_key)
SELECT scope_key, last_processed_feedback_id, cooldown_until, consecutive_failures FROM fx_scope_state
UNION ALL
SELECT scope_key, last_processed_feedback_id, CAST(NULL AS TIMESTAMP), 0 FROM mx
WHERE scope_key NOT IN (SELECT scope_key FROM fx_scope_state)""")
def _scope_state_init(fx):
    return ST.scope_state_init(fx.scope_state, SC.feedback_scopes(fx.feedback, fx.prediction_log))


_CAND_SQL = f"""
WITH {SCOPED_SQL}, {BATCHES_SQL},
cb AS (SELECT scope_key, batch_no, any_value(scope_clinic) AS scope_clinic, list_sort(list(id)) AS ids
       FROM batches GROUP BY scope_key, batch_no),
keyed AS (SELECT *, sha256('[' || array_to_string(ids, ',') || ']') AS idempotency_key FROM cb)"""


@query("insert_job_once", _CAND_SQL + f"""
SELECT 'running' AS status, {AS_OF_SQL} AS start_time, {blank_null_sql('scope_clinic')} AS clinic_id,
       idempotency_key, ids[1] AS batch_start_feedback_id, ids[len(ids)] AS batch_end_feedback_id,
       CAST(len(ids) AS INTEGER) AS eligible_feedback_count, 'automatic' AS trigger_type,
       array_to_string(ids, ',') AS batch_ids
FROM keyed
WHERE idempotency_key NOT IN (SELECT idempotency_key FROM keyed WHERE batch_no = 1)""")
def _insert_job_once(fx):
    b = _batches(fx)
    cand = b.groupBy("scope_key", "batch_no").agg(F.first("scope_clinic").alias("scope_clinic"),
                                                  F.collect_list("id").alias("batch_ids"))
    existing = (cand.where(F.col("batch_no") == 1)
                .select(S.batch_idempotency_key(F.array_sort("batch_ids")).alias("idempotency_key")))
    out = ST.insert_job_once(cand, existing, AS_OF)
    return out.withColumn("batch_ids", F.array_join(F.col("batch_ids").cast("array<string>"), ","))


# ----------------------------------------------------------------- WIN / TOP
@query("watermark_batches", f"""
WITH {SCOPED_SQL}, {BATCHES_SQL}
SELECT scope_key, scope_clinic, id, pos, batch_no FROM batches""")
def _watermark_batches(fx):
    return _batches(fx).select("scope_key", "scope_clinic", "id", "pos", "batch_no")


@query("next_batch_ids", f"""
WITH {SCOPED_SQL}, {BATCHES_SQL}
SELECT scope_key, id FROM num WHERE pos <= {T}""")
def _next_batch_ids(fx):
    scoped = SC.feedback_scopes(fx.feedback, fx.prediction_log)
    cand = ST.batch_candidates(scoped, fx.scope_state, AS_OF, W)
    return ST.first_candidates(cand, T).select("scope_key", "id")


@query("failure_streak", f"""
WITH j AS (SELECT *, {_JOB_SCOPE_SQL} AS scope_key FROM fx_job),
lo AS (SELECT scope_key, max(CASE WHEN lower(status) = 'completed' THEN training_id END) AS last_ok FROM j
       GROUP BY scope_key),
a AS (SELECT j.scope_key,
             count(*) FILTER (WHERE lower(status) = 'failed' AND (last_ok IS NULL OR training_id > last_ok)) AS n,
             max(CASE WHEN lower(status) = 'failed' AND (last_ok IS NULL OR training_id > last_ok)
                      THEN COALESCE(end_time, start_time) END) AS last_fail
      FROM j JOIN lo ON j.scope_key = lo.scope_key GROUP BY j.scope_key)
SELECT scope_key, CAST(n AS INTEGER) AS consecutive_failures,
       CASE WHEN n > 0 THEN CAST(least(900, 30 * pow(2, least(n, 5))) AS INTEGER) END AS cooldown_s,
       CASE WHEN n > 0 THEN last_fail + to_seconds(CAST(least(900, 30 * pow(2, least(n, 5))) AS BIGINT)) END
         AS cooldown_until
FROM a""")
def _failure_streak(fx):
    return J.failure_streak(fx.job, AS_OF)


@query("job_deltas", f"""
WITH d AS (SELECT {_JOB_SCOPE_SQL} AS scope_key, training_id, new_model_version, cv_mean_f1_weighted AS metric
           FROM fx_job WHERE lower(status) = 'completed' AND COALESCE(is_deployed, FALSE))
SELECT scope_key, training_id, new_model_version, metric,
       lag(new_model_version) OVER w AS baseline_version, lag(metric) OVER w AS baseline_metric,
       metric - lag(metric) OVER w AS metric_delta
FROM d WINDOW w AS (PARTITION BY scope_key ORDER BY training_id)""")
def _job_deltas(fx):
    return J.job_deltas(fx.job)


@query("job_history_page", """
SELECT training_id, status, clinic_id FROM fx_job ORDER BY training_id DESC LIMIT 10 OFFSET 20""")
def _job_history_page(fx):
    return J.job_history_page(fx.job, limit=10, offset=20).select("training_id", "status", "clinic_id")


@query("last_training", f"""
WITH b AS (SELECT *, {blank_null_sql('clinic_id')} AS scope FROM fx_job WHERE {blank_null_sql('clinic_id')} IS NOT NULL
           UNION ALL SELECT *, 'global' AS scope FROM fx_job),
t AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY training_id DESC) AS r FROM b),
k AS (SELECT * FROM t)
SELECT scope,
       max(CASE WHEN r = 1 THEN training_id END) AS last_training_id,
       max(CASE WHEN r = 1 THEN status END) AS last_status,
       max(CASE WHEN lower(status) = 'completed' AND COALESCE(is_deployed, FALSE) THEN training_id END)
         AS last_successful_training_id,
       arg_max(new_model_version, training_id) FILTER (WHERE lower(status) = 'completed' AND COALESCE(is_deployed, FALSE))
         AS last_successful_version
FROM k GROUP BY scope""")
def _last_training(fx):
    return J.last_training(fx.job)


@query("last_success_time", """
SELECT max(end_time) AS last_success_time
FROM fx_job
WHERE lower(status) = 'completed' AND end_time IS NOT NULL""")
def _last_success_time(fx):
    return J.last_success_time(fx.job)


@query("jobs_by_status", """
WITH s AS (SELECT * FROM (VALUES ('pending'), ('running'), ('completed'), ('failed')) AS t(status)),
c AS (SELECT lower(status) AS status, count(*) AS n FROM fx_job GROUP BY 1)
SELECT s.status, CAST(COALESCE(c.n, 0) AS BIGINT) AS job_count FROM s LEFT JOIN c ON s.status = c.status""")
def _jobs_by_status(fx):
    return J.jobs_by_status(fx.job)


@query("jobs_total", """
SELECT 'clinic' AS level, clinic_id, count(*) AS job_count FROM fx_job GROUP BY clinic_id
UNION ALL SELECT 'total', NULL, count(*) FROM fx_job""")
def _jobs_total(fx):
    return J.jobs_total(fx.job)


@query("training_overview", f"""
WITH c AS (SELECT lower(status) AS status, count(*) AS n FROM fx_job GROUP BY 1),
g AS (SELECT count(*) AS total_feedback,
             count(*) FILTER (WHERE is_training_eligible AND created_at >= {WIN_SQL}) AS eligible_feedback
      FROM fx_feedback WHERE training_pool = 'GLOBAL'),
r AS (SELECT string_agg(CAST(training_id AS VARCHAR), ',' ORDER BY training_id DESC) AS recent_training_ids
      FROM (SELECT training_id FROM fx_job ORDER BY training_id DESC LIMIT 5))
SELECT COALESCE((SELECT n FROM c WHERE status = 'running'), 0) AS active_jobs,
       COALESCE((SELECT n FROM c WHERE status = 'completed'), 0) AS completed_jobs,
       COALESCE((SELECT n FROM c WHERE status = 'failed'), 0) AS failed_jobs,
       COALESCE((SELECT sum(n) FROM c WHERE status IN ('pending', 'running', 'completed', 'failed')), 0) AS total_jobs,
       (SELECT count(*) FROM fx_prediction_log) AS total_predictions,
       g.total_feedback, g.eligible_feedback, g.eligible_feedback >= {DEFAULT.min_feedback_for_training}
         AS is_eligible_for_training,
       r.recent_training_ids
FROM g, r""")
def _training_overview(fx):
    return J.training_overview(fx.job, fx.prediction_log, fx.feedback, AS_OF, W)
