"""Upserts, deletes and scope-state updates as pure ``(target, changes) -> new target``.

Without a lakehouse format each function returns the full new table; the same
key/merge specification maps one-to-one onto ``DataFrame.mergeInto`` when the
target is a Delta/Iceberg table.  Deduplication uses ``max_by`` aggregations
(partial aggregation absorbs hot keys) instead of ``row_number`` windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from looplake.config import DEFAULT, Config
from looplake.functions import scalars as S
from looplake.operators import ordering as O
from looplake.operators.scope import _ts, window_start


def latest_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key: the row with the greatest ``order_col`` (hash aggregation, no window)."""
    cols = df.columns
    return (df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_r"))
            .select("_r.*"))


def upsert_predictions(target: DataFrame, changes: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Insert-or-update by id.  Updated rows take every new value except ``clinic_id``
    (``COALESCE(new, old)``) and ``created_at`` (kept).  Duplicate changes: latest ``seq`` wins."""
    ch = latest_per_key(changes, "id", seq_col).drop(seq_col)
    cols = target.columns
    t = target.select(*[F.col(c).alias(f"o_{c}") for c in cols])
    n = ch.select(*[F.col(c).alias(f"n_{c}") for c in cols])
    j = t.join(n, F.col("o_id") == F.col("n_id"), "full_outer")
    matched_new = F.col("n_id").isNotNull()
    out = []
    for c in cols:
        if c == "clinic_id":
            e = F.when(matched_new, F.coalesce(F.col("n_clinic_id"), F.col("o_clinic_id"))).otherwise(F.col("o_clinic_id"))
        elif c == "created_at":
            e = F.coalesce(F.col("o_created_at"), F.col("n_created_at"))
        else:
            e = F.when(matched_new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        out.append(e.alias(c))
    return j.select(*out)


def upsert_feedback(target: DataFrame, changes: DataFrame, as_of, seq_col: str = "seq") -> DataFrame:
    """One row per prediction_id, latest wins; the old row's ``id`` is kept; ``created_at`` = as_of
    for every inserted or updated row."""
    ch = latest_per_key(changes, "prediction_id", seq_col).drop(seq_col)
    cols = target.columns
    t = target.select(*[F.col(c).alias(f"o_{c}") for c in cols])
    n = ch.select(*[F.col(c).alias(f"n_{c}") for c in cols if c in ch.columns])
    j = t.join(n, F.col("o_prediction_id") == F.col("n_prediction_id"), "full_outer")
    has_new = F.col("n_prediction_id").isNotNull()
    out = []
    for c in cols:
        if c == "id":
            e = F.coalesce(F.col("o_id"), F.col("n_id"))
        elif c == "created_at":
            e = F.when(has_new, _ts(as_of)).otherwise(F.col("o_created_at"))
        elif c in ch.columns:
            e = F.when(has_new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        else:
            e = F.col(f"o_{c}")
        out.append(e.alias(c))
    return j.select(*out)


def dedup_feedback(feedback: DataFrame) -> DataFrame:
    """Legacy clean-up: keep the row with max(id) per prediction_id."""
    return latest_per_key(feedback, "prediction_id", "id")


def upsert_policy(target: DataFrame, changes: DataFrame, as_of, seq_col: str = "seq", strict: bool = True
                  ) -> DataFrame:
    """Set clinics' pools.  Blank clinic or invalid pool raises (strict) or is dropped."""
    c = changes.select(S.strip("clinic_id").alias("clinic_id"), F.upper(S.strip("feedback_pool")).alias("feedback_pool"),
                       F.col(seq_col))
    bad = (F.col("clinic_id").isNull() | (F.col("clinic_id") == "")
           | ~F.col("feedback_pool").isin("GLOBAL", "CLINIC_ONLY"))
    if strict:
        c = c.withColumn("feedback_pool", F.when(bad, F.raise_error(F.lit(
            "feedback_pool must be GLOBAL or CLINIC_ONLY and clinic_id is required"))).otherwise(F.col("feedback_pool")))
    else:
        c = c.where(~bad)
    latest = latest_per_key(c, "clinic_id", seq_col).select("clinic_id", "feedback_pool",
                                                              _ts(as_of).alias("updated_at"))
    old = target.select("clinic_id", "feedback_pool",
                        (F.col("updated_at") if "updated_at" in target.columns
                         else F.lit(None).cast("timestamp")).alias("updated_at"))
    return old.join(latest.select("clinic_id"), "clinic_id", "left_anti").unionByName(latest)


def scope_membership(feedback: DataFrame, predictions: DataFrame, clinic_id: str | None) -> DataFrame:
    """Flag column ``_in_scope`` for a single scope (global pool, or a clinic's CLINIC_ONLY rows)."""
    if clinic_id is None:
        return feedback.withColumn("_in_scope", F.col("training_pool") == "GLOBAL")
    ids = (predictions.where(F.col("clinic_id") == F.lit(clinic_id)).select(F.col("id").alias("_sid")).distinct())
    j = feedback.join(ids, feedback["prediction_id"] == F.col("_sid"), "left")
    return (j.withColumn("_in_scope", (F.col("training_pool") == "CLINIC_ONLY") & F.col("_sid").isNotNull())
            .drop("_sid"))


def consume_scope(feedback: DataFrame, predictions: DataFrame, clinic_id: str | None) -> DataFrame:
    """After training: every eligible row of the scope becomes ineligible; ``consumed`` flags them."""
    m = scope_membership(feedback, predictions, clinic_id)
    hit = F.col("_in_scope") & (F.col("is_training_eligible") == F.lit(True))
    return (m.withColumn("consumed", F.coalesce(hit, F.lit(False)))
            .withColumn("is_training_eligible", F.when(F.col("consumed"), F.lit(False))
                        .otherwise(F.col("is_training_eligible")))
            .drop("_in_scope"))


def consume_batch(feedback: DataFrame, predictions: DataFrame, clinic_id: str | None, batch_ids: DataFrame
                  ) -> DataFrame:
    """Same as :func:`consume_scope` restricted to a batch of feedback ids (``batch_ids.id``)."""
    m = scope_membership(feedback, predictions, clinic_id)
    b = batch_ids.select(F.col("id").cast("bigint").alias("_bid")).distinct()
    j = m.join(b, F.col("id") == F.col("_bid"), "left")
    hit = F.col("_in_scope") & (F.col("is_training_eligible") == F.lit(True)) & F.col("_bid").isNotNull()
    return (j.withColumn("consumed", F.coalesce(hit, F.lit(False)))
            .withColumn("is_training_eligible", F.when(F.col("consumed"), F.lit(False))
                        .otherwise(F.col("is_training_eligible")))
            .drop("_in_scope", "_bid"))


def clear_scope(feedback: DataFrame, predictions: DataFrame, clinic_id: str | None) -> DataFrame:
    """Delete the scope's feedback (GLOBAL pool, or one clinic's CLINIC_ONLY rows)."""
    m = scope_membership(feedback, predictions, clinic_id)
    return m.where(~F.coalesce(F.col("_in_scope"), F.lit(False))).drop("_in_scope")


def clear_all(predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Counts of both tables before they are emptied (the new state is ``limit(0)`` of each)."""
    p = predictions.agg(F.count(F.lit(1)).alias("predictions"))
    f = feedback.agg(F.count(F.lit(1)).alias("feedback"))
    return p.crossJoin(f)


def purge_jobs(jobs: DataFrame, *, training_id: int | None = None, all_rows: bool = False,
               only_global: bool = False, clinic_id: str | None = None) -> DataFrame:
    """Remaining jobs after a delete; exactly one mode may be given."""
    modes = [training_id is not None, all_rows, only_global, clinic_id is not None]
    if sum(modes) != 1:
        raise ValueError("exactly one purge mode is required")
    if training_id is not None:
        return jobs.where(F.col("training_id") != F.lit(int(training_id)))
    if all_rows:
        return jobs.limit(0)
    if only_global:
        return jobs.where(F.col("clinic_id").isNotNull())
    return jobs.where(~F.col("clinic_id").eqNullSafe(F.lit(clinic_id.strip())))


JOB_STATE_COLUMNS = ("status", "start_time", "end_time", "new_model_version", "training_accuracy",
                     "validation_accuracy", "f1_score", "is_deployed", "error_message")


def job_lifecycle(events: DataFrame) -> DataFrame:
    """Fold an append-only job-event table (training_id, seq, field columns; null = unchanged)
    into the current job rows, error text whole."""
    present = [c for c in JOB_STATE_COLUMNS if c in events.columns]
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in present]
    return events.groupBy("training_id").agg(*aggs, F.max("seq").alias("last_seq"))


def job_timeout(jobs: DataFrame, as_of, cfg: Config = DEFAULT) -> DataFrame:
    """Running jobs older than the in-process limit become failed with the timeout message."""
    stale = (F.col("status") == "running") & (F.col("start_time") < _ts(as_of) - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(cfg.job_timeout_seconds)))
    return (jobs.withColumn("timed_out", F.coalesce(stale, F.lit(False)))
            .withColumn("status", F.when(F.col("timed_out"), F.lit("failed")).otherwise(F.col("status")))
            .withColumn("end_time", F.when(F.col("timed_out"), _ts(as_of)).otherwise(F.col("end_time")))
            .withColumn("error_message", F.when(F.col("timed_out"), F.lit("Training timeout after 5 minutes"))
                        .otherwise(F.col("error_message") if "error_message" in jobs.columns
                                   else F.lit(None).cast("string"))))


def scope_state_success(state: DataFrame, successes: DataFrame, as_of) -> DataFrame:
    """Successful batch per scope: watermark = max batch id, failures 0, cooldown cleared."""
    s = successes.groupBy("scope_key").agg(F.max("last_feedback_id").alias("_wm"))
    j = state.join(s, "scope_key", "left")
    hit = F.col("_wm").isNotNull()
    return j.select(
        "scope_key",
        F.when(hit, F.col("_wm")).otherwise(F.col("last_processed_feedback_id")).cast("bigint")
        .alias("last_processed_feedback_id"),
        F.when(hit, F.lit(None).cast("timestamp")).otherwise(F.col("cooldown_until")).alias("cooldown_until"),
        F.when(hit, F.lit(0)).otherwise(F.col("consecutive_failures")).cast("int").alias("consecutive_failures"))


def scope_state_failure(state: DataFrame, failures: DataFrame, as_of, cfg: Config = DEFAULT) -> DataFrame:
    """One failure per listed scope: failures + 1 and exponential cooldown; a missing scope row is
    inserted with watermark 0."""
    f = failures.select("scope_key").distinct().withColumn("_hit", F.lit(True))
    j = state.join(f, "scope_key", "full_outer")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    nfail = F.coalesce(F.col("consecutive_failures"), F.lit(0)) + 1
    until = _ts(as_of) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), S.cooldown_seconds(nfail, cfg))
    return j.select(
        "scope_key",
        F.coalesce(F.col("last_processed_feedback_id"), F.lit(0)).cast("bigint").alias("last_processed_feedback_id"),
        F.when(hit, until).otherwise(F.col("cooldown_until")).alias("cooldown_until"),
        F.when(hit, nfail).otherwise(F.col("consecutive_failures")).cast("int").alias("consecutive_failures"))


def scope_state_init(state: DataFrame, scoped_feedback: DataFrame) -> DataFrame:
    """Missing scopes get a row anchored at their current max feedback id; existing rows untouched."""
    mx = scoped_feedback.groupBy("scope_key").agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")
                                                  .alias("last_processed_feedback_id"))
    new = (mx.join(state.select("scope_key"), "scope_key", "left_anti")
           .withColumn("cooldown_until", F.lit(None).cast("timestamp"))
           .withColumn("consecutive_failures", F.lit(0)))
    return state.select("scope_key", "last_processed_feedback_id", "cooldown_until",
                        "consecutive_failures").unionByName(new)


def batch_candidates(scoped_feedback: DataFrame, state: DataFrame, as_of, window_days: int) -> DataFrame:
    """Eligible (scope_key, scope_clinic, id) inside the window and after the scope's watermark.  A
    scope without a state row starts at its current max id (so it has no candidate yet)."""
    mx = scoped_feedback.groupBy("scope_key").agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max_id"))
    wm = (mx.join(state.select("scope_key", "last_processed_feedback_id"), "scope_key", "left")
          .select("scope_key", F.coalesce(F.col("last_processed_feedback_id"), F.col("_max_id")).alias("_wm")))
    return (scoped_feedback.where((F.col("is_training_eligible") == F.lit(True))
                                  & (F.col("created_at") >= window_start(as_of, window_days)))
            .select("scope_key", "scope_clinic", "id")
            .join(wm, "scope_key", "inner").where(F.col("id") > F.col("_wm")).drop("_wm"))


def first_candidates(candidates: DataFrame, size: int) -> DataFrame:
    """The first ``size`` ids of each scope with their position: a window group limit keeps at most
    ``size`` rows of a scope per task before the shuffle, so nothing is numbered in full."""
    w = Window.partitionBy("scope_key").orderBy("id")
    return candidates.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= size)


def watermark_batches(scoped_feedback: DataFrame, state: DataFrame, as_of, window_days: int, batch_size: int
                      ) -> DataFrame:
    """Consecutive full batches of ``batch_size`` eligible ids after each scope's watermark.

    Numbering is the distributed per-scope row number, so a hot
    scope is spread over many tasks.
    """
    cand = batch_candidates(scoped_feedback, state, as_of, window_days)
    numbered = O.with_row_number(cand, ["id"], "pos", partition_cols=["scope_key"])
    numbered = numbered.withColumn("batch_no", F.floor((F.col("pos") - 1) / F.lit(batch_size)).cast("int"))
    sizes = numbered.groupBy("scope_key", "batch_no").agg(F.count(F.lit(1)).alias("_n"))
    return (numbered.join(sizes, ["scope_key", "batch_no"]).where(F.col("_n") == batch_size).drop("_n"))


def insert_job_once(candidates: DataFrame, existing_jobs: DataFrame, as_of) -> DataFrame:
    """New running jobs for batches whose idempotency key is not yet used.

    ``candidates``: (scope_key, scope_clinic, batch_ids array<bigint>).  Anti
    join on the key is the unique-index guard.
    """
    c = (candidates.withColumn("batch_ids", F.array_sort(F.array_distinct(F.col("batch_ids"))))
         .withColumn("idempotency_key", S.batch_idempotency_key("batch_ids")))
    used = existing_jobs.where(F.col("idempotency_key").isNotNull()).select("idempotency_key")
    fresh = c.join(used, "idempotency_key", "left_anti")
    return fresh.select(
        F.lit("running").alias("status"), _ts(as_of).alias("start_time"),
        S.normalize_clinic_key("scope_clinic").alias("clinic_id"), "idempotency_key",
        F.array_min("batch_ids").alias("batch_start_feedback_id"),
        F.array_max("batch_ids").alias("batch_end_feedback_id"),
        F.size("batch_ids").alias("eligible_feedback_count"),
        F.lit("automatic").alias("trigger_type"), "batch_ids")
