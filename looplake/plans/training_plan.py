"""Which scopes to train, and the automatic batch plan — computed for every scope at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looplake.config import DEFAULT, Config
from looplake.functions import scalars as S
from looplake.operators import jobs as J
from looplake.operators import scope as SC
from looplake.operators import state as ST
from looplake.operators.scope import _ts
from looplake.session import cut_lineage


def global_eligible_count(feedback: DataFrame, as_of, days: int) -> DataFrame:
    """Eligible GLOBAL-pool feedback inside the window (the global scope's count)."""
    return (feedback.where((F.col("training_pool") == "GLOBAL") & (F.col("is_training_eligible") == F.lit(True))
                           & (F.col("created_at") >= SC.window_start(as_of, days)))
            .agg(F.count(F.lit(1)).alias("eligible_feedback_count")))


def training_plan(feedback: DataFrame, predictions: DataFrame, as_of, cfg: Config = DEFAULT,
                  force: bool = False) -> DataFrame:
    """Unscoped trigger: fan out to every clinic at/over the threshold (> 0 when forced); with no
    such clinic, the global scope is checked, and a global run is redirected to the only clinic
    with eligible feedback when there is exactly one."""
    days, thr = cfg.feedback_window_days, cfg.min_feedback_for_training
    clinics = SC.eligible_by_clinic(feedback, predictions, as_of, days)
    cond = (F.col("eligible_feedback_count") > 0) if force else (F.col("eligible_feedback_count") >= thr)
    targets = clinics.where(cond)
    n_targets = targets.agg(F.count(F.lit(1)).alias("_nt"))
    fan = targets.select(F.col("clinic_id").alias("scope"), "eligible_feedback_count",
                         F.lit("triggered_multi_clinic").alias("decision"), F.lit(None).cast("string").alias("reason"))
    g = global_eligible_count(feedback, as_of, days)
    single = SC.infer_single_clinic(feedback, predictions, as_of, days).select(F.col("clinic_id").alias("_redirect"))
    ok = (F.col("eligible_feedback_count") > 0) if force else (F.col("eligible_feedback_count") >= thr)
    reason = (F.lit("No eligible feedback data to train on.") if force else
              F.format_string(f"Insufficient data: %d < {thr}", F.col("eligible_feedback_count")))
    glob = (g.crossJoin(n_targets).crossJoin(single).where(F.col("_nt") == 0)
            .select(F.coalesce(F.col("_redirect"), F.lit("global")).alias("scope"), "eligible_feedback_count",
                    F.when(ok, F.lit("triggered")).otherwise(F.lit("rejected")).alias("decision"),
                    F.when(ok, F.lit(None).cast("string")).otherwise(reason).alias("reason")))
    return fan.unionByName(glob)


def eligibility_check(feedback: DataFrame, predictions: DataFrame, policy: DataFrame, as_of,
                      cfg: Config = DEFAULT) -> DataFrame:
    """Per scope (global and every clinic with predictions): eligible count vs threshold, the
    clinic's pool policy, and the next check date (as_of + 1 day)."""
    days, thr = cfg.feedback_window_days, cfg.min_feedback_for_training
    g = global_eligible_count(feedback, as_of, days).select(
        F.lit(None).cast("string").alias("clinic_id"), "eligible_feedback_count")
    counts = SC.eligible_by_clinic(feedback, predictions, as_of, days)
    clinics = (predictions.select(S.normalize_clinic_key("clinic_id").alias("clinic_id"))
               .where(F.col("clinic_id").isNotNull()).distinct())
    c = clinics.join(counts, "clinic_id", "left").select(
        "clinic_id", F.coalesce("eligible_feedback_count", F.lit(0)).cast("bigint").alias("eligible_feedback_count"))
    pol = SC.policy_lookup(clinics, policy)
    both = g.unionByName(c).join(pol, "clinic_id", "left")
    return both.select(
        "clinic_id", "eligible_feedback_count", F.lit(thr).alias("training_threshold"),
        (F.col("eligible_feedback_count") >= thr).alias("is_eligible_for_training"),
        F.lit(days).alias("training_window_days"),
        F.when(F.col("clinic_id").isNull(), F.lit("global")).otherwise(F.lit("clinic")).alias("training_scope"),
        F.when(F.col("clinic_id").isNull(), F.lit(None).cast("string")).otherwise(F.col("feedback_pool"))
        .alias("clinic_feedback_pool_policy"),
        (_ts(as_of) + F.make_dt_interval(F.lit(1))).alias("next_check_date"))


def auto_batch_plan(feedback: DataFrame, predictions: DataFrame, state: DataFrame, jobs: DataFrame, as_of,
                    cfg: Config = DEFAULT) -> DataFrame:
    """Per scope: skip when in cooldown or a job of the scope is running, skip when fewer than T
    eligible ids follow the watermark, skip a batch whose idempotency key is already used,
    otherwise plan a job for the first T ids (with the snapshot row count)."""
    t, days = cfg.auto_batch_size, cfg.feedback_window_days
    # the scope tagging (feedback ⋈ predictions) feeds five branches: materialize it once
    scoped = cut_lineage(SC.feedback_scopes(feedback, predictions).select(
        "scope_key", "scope_clinic", "id", "prediction_id", "is_training_eligible", "created_at"))
    scopes = scoped.select("scope_key", "scope_clinic").distinct()
    cool = SC.scopes_in_cooldown(state, as_of).select("scope_key").withColumn("_cool", F.lit(True))
    live = ST.job_timeout(jobs, as_of, cfg)
    running = SC.null_safe_scope_join(scopes, live).select("scope_key").withColumn("_run", F.lit(True))
    heads = ST.first_candidates(ST.batch_candidates(scoped, state, as_of, days), t)  # at most t rows a scope
    first = heads.groupBy("scope_key").agg(F.array_sort(F.collect_list("id")).alias("batch_ids")) \
        .where(F.size("batch_ids") == t)
    batches = heads.join(first.select("scope_key"), "scope_key", "left_semi")
    used = (jobs.select("idempotency_key") if "idempotency_key" in jobs.columns
            else jobs.sparkSession.createDataFrame([], "idempotency_key string"))
    used = used.where(F.col("idempotency_key").isNotNull()).distinct().withColumn("_dup", F.lit(True))
    p = predictions.select(F.col("id").cast("string").alias("_pid")).distinct()
    snap = (batches.join(scoped.select("id", "prediction_id"), "id")
            .join(p, F.col("prediction_id").cast("string") == F.col("_pid"), "left_semi")
            .groupBy("scope_key").agg(F.count(F.lit(1)).alias("snapshot_rows")))
    j = (scopes.join(cool, "scope_key", "left").join(running, "scope_key", "left").join(first, "scope_key", "left")
         .withColumn("idempotency_key", F.when(F.col("batch_ids").isNotNull(), S.batch_idempotency_key("batch_ids")))
         .join(used, "idempotency_key", "left").join(snap, "scope_key", "left"))
    decision = (F.when(~F.lit(cfg.auto_batch_enabled), F.lit("skip_disabled"))
                .when(F.col("_cool"), F.lit("skip_cooldown"))
                .when(F.col("_run"), F.lit("skip_running"))
                .when(F.col("batch_ids").isNull(), F.lit("skip_insufficient"))
                .when(F.col("_dup"), F.lit("skip_duplicate"))
                .otherwise(F.lit("create")))
    create = decision == "create"
    return j.select("scope_key", decision.alias("decision"),
                    F.when(create, F.array_join(F.col("batch_ids").cast("array<string>"), ",")).alias("batch_ids"),
                    F.when(create, F.col("idempotency_key")).alias("idempotency_key"),
                    F.when(create, F.coalesce("snapshot_rows", F.lit(0))).alias("snapshot_rows"))
