"""Training-job history: counts, pages, last jobs, failure streaks and metric deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looplake.config import DEFAULT, Config
from looplake.functions import scalars as S
from looplake.operators import ordering as O
from looplake.operators.scope import window_start

# The four job statuses reported (others are dropped).
JOB_STATUSES = ("pending", "running", "completed", "failed")


def job_scope_key(clinic_col: str = "clinic_id"):
    ck = S.normalize_clinic_key(clinic_col)
    return F.when(ck.isNull(), F.lit("global:GLOBAL")).otherwise(F.concat(F.lit("clinic:"), ck, F.lit(":CLINIC_ONLY")))


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    """Four statuses, zero-filled; status text lower-cased; spellings of one status add up."""
    spark = jobs.sparkSession
    st = spark.createDataFrame([(s,) for s in JOB_STATUSES], "status string")
    c = jobs.groupBy(F.lower(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(st).join(c, "status", "left")
            .select("status", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("job_count")))


def jobs_total(jobs: DataFrame) -> DataFrame:
    """Total jobs and per-clinic totals (clinic NULL = global jobs)."""
    per = jobs.groupBy("clinic_id").agg(F.count(F.lit(1)).alias("job_count"))
    tot = per.agg(F.coalesce(F.sum("job_count"), F.lit(0)).cast("bigint").alias("job_count"))
    return (per.select(F.lit("clinic").alias("level"), "clinic_id", "job_count")
            .unionByName(tot.select(F.lit("total").alias("level"), F.lit(None).cast("string").alias("clinic_id"),
                                    "job_count")))


def job_history_page(jobs: DataFrame, limit: int = 10, offset: int = 0, clinic_id: str | None = None) -> DataFrame:
    """Newest first by training_id; limit >= 1, offset >= 0 (a top-k page)."""
    limit, offset = max(1, int(limit)), max(0, int(offset))
    df = jobs if clinic_id is None else jobs.where(F.col("clinic_id") == F.lit(clinic_id))
    return df.orderBy(F.desc("training_id")).offset(offset).limit(limit)


def last_success_time(jobs: DataFrame) -> DataFrame:
    """Latest end_time among all completed jobs."""
    return (jobs.where((F.lower(F.col("status")) == "completed") & F.col("end_time").isNotNull())
            .agg(F.max("end_time").alias("last_success_time")))


def last_training(jobs: DataFrame) -> DataFrame:
    """Per scope (each clinic, plus global = all jobs): newest job and newest completed & deployed
    job, over all jobs (max_by: partial aggregates, no window)."""
    clinic = jobs.where(S.normalize_clinic_key("clinic_id").isNotNull()).withColumn(
        "scope", S.normalize_clinic_key("clinic_id"))
    glob = jobs.withColumn("scope", F.lit("global"))
    ok = (F.lower(F.col("status")) == "completed") & F.coalesce(F.col("is_deployed"), F.lit(False))
    done = F.when(ok, F.col("training_id"))
    return clinic.unionByName(glob).groupBy("scope").agg(
        F.max("training_id").alias("last_training_id"), F.max_by("status", "training_id").alias("last_status"),
        F.max(done).alias("last_successful_training_id"),
        F.max_by("new_model_version", done).alias("last_successful_version"))


def training_overview(jobs: DataFrame, predictions: DataFrame, feedback: DataFrame, as_of, window_days: int,
                      cfg: Config = DEFAULT) -> DataFrame:
    """One-row overview: job counts, totals (global pool for feedback), eligibility, last 5 job ids."""
    c = jobs_by_status(jobs).groupBy().pivot("status", list(JOB_STATUSES)).agg(F.first("job_count"))
    preds = predictions.agg(F.count(F.lit(1)).alias("total_predictions"))
    g = feedback.where(F.col("training_pool") == "GLOBAL")
    fb = g.agg(F.count(F.lit(1)).alias("total_feedback"),
               F.count_if((F.col("is_training_eligible") == F.lit(True))
                          & (F.col("created_at") >= window_start(as_of, window_days))).alias("eligible_feedback"))
    recent = (jobs.orderBy(F.desc("training_id")).limit(5)
              .agg(F.sort_array(F.collect_list(F.col("training_id")), asc=False).alias("_ids"))
              .select(F.array_join(F.col("_ids").cast("array<string>"), ",").alias("recent_training_ids")))
    out = c.crossJoin(preds).crossJoin(fb).crossJoin(recent)
    return out.select(
        F.col("running").alias("active_jobs"), F.col("completed").alias("completed_jobs"),
        F.col("failed").alias("failed_jobs"),
        (F.col("running") + F.col("completed") + F.col("failed") + F.col("pending")).alias("total_jobs"),
        "total_predictions", "total_feedback", "eligible_feedback",
        (F.col("eligible_feedback") >= cfg.min_feedback_for_training).alias("is_eligible_for_training"),
        "recent_training_ids")


def failure_streak(jobs: DataFrame, as_of, cfg: Config = DEFAULT) -> DataFrame:
    """Consecutive failures since the last success per scope and the cooldown they imply.

    Gaps-and-islands as one aggregation: the streak is the number of failed
    jobs after the scope's last completed job (no window, skew-safe).
    """
    j = jobs.withColumn("scope_key", job_scope_key())
    last_ok = j.groupBy("scope_key").agg(
        F.max(F.when(F.lower("status") == "completed", F.col("training_id"))).alias("_last_ok"))
    k = j.join(last_ok, "scope_key")
    after = (F.lower(F.col("status")) == "failed") & (F.col("_last_ok").isNull()
                                                     | (F.col("training_id") > F.col("_last_ok")))
    agg = k.groupBy("scope_key").agg(F.count_if(after).alias("consecutive_failures"),
                                     F.max(F.when(after, F.coalesce("end_time", "start_time"))).alias("_last_fail"))
    secs = S.cooldown_seconds(F.col("consecutive_failures"), cfg)
    return agg.select(
        "scope_key", F.col("consecutive_failures").cast("int").alias("consecutive_failures"),
        F.when(F.col("consecutive_failures") > 0, secs).alias("cooldown_s"),
        F.when(F.col("consecutive_failures") > 0,
               F.col("_last_fail") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)).alias("cooldown_until"))


def lag_by(df: DataFrame, partition_cols: list, order_col: str, value_cols: list[str], prefix: str = "prev_"
           ) -> DataFrame:
    """``lag(v) over (partition by P order by o)`` as a distributed row number + self join."""
    n = O.with_row_number(df, [order_col], "_pos", partition_cols=partition_cols)
    prev = n.select(*partition_cols, (F.col("_pos") + 1).alias("_pos"),
                    *[F.col(v).alias(prefix + v) for v in value_cols])
    return n.join(prev, partition_cols + ["_pos"], "left").drop("_pos")


def job_deltas(jobs: DataFrame, metric: str = "cv_mean_f1_weighted") -> DataFrame:
    """For deployed completed jobs: metric minus the previous deployed job's metric in the scope."""
    d = (jobs.where((F.lower("status") == "completed") & F.coalesce(F.col("is_deployed"), F.lit(False)))
         .withColumn("scope_key", job_scope_key())
         .select("scope_key", "training_id", "new_model_version", F.col(metric).alias("metric")))
    l = lag_by(d, ["scope_key"], "training_id", ["metric", "new_model_version"])
    return l.select("scope_key", "training_id", "new_model_version", "metric",
                    F.col("prev_new_model_version").alias("baseline_version"),
                    F.col("prev_metric").alias("baseline_metric"),
                    (F.col("metric") - F.col("prev_metric")).alias("metric_delta"))


def job_status(jobs: DataFrame, requested: DataFrame, predictions: DataFrame, feedback: DataFrame, as_of,
               window_days: int) -> DataFrame:
    """Status rows for requested job ids: progress fields split out of the metrics JSON; an
    unknown id gets the default pending row with current totals."""
    m = F.from_json(F.col("training_metrics"), "map<string,string>")
    j = requested.join(jobs.withColumn("_m", m).withColumn("_known", F.lit(True)), "training_id", "left")
    tp = predictions.agg(F.count(F.lit(1)).alias("_tp"))
    ef = (feedback.where((F.col("training_pool") == "GLOBAL") & (F.col("is_training_eligible") == F.lit(True))
                         & (F.col("created_at") >= window_start(as_of, window_days)))
          .agg(F.count(F.lit(1)).alias("_ef")))
    j = j.crossJoin(F.broadcast(tp)).crossJoin(F.broadcast(ef))
    unknown = F.col("_known").isNull()
    rest = F.map_filter(F.col("_m"), lambda k, v: ~k.isin("current_phase", "progress_pct"))
    return j.select(
        "training_id", F.coalesce(F.col("status"), F.lit("pending")).alias("status"),
        F.col("_m")["current_phase"].alias("current_phase"),
        F.col("_m")["progress_pct"].cast("int").alias("progress_pct"),
        F.array_join(F.array_sort(F.map_keys(rest)), ",").alias("phase_metric_keys"),
        F.when(unknown, F.col("_tp")).alias("total_predictions"),
        F.when(unknown, F.col("_ef")).alias("eligible_feedback_count"),
        F.when(unknown, F.lit("Training job not found")).alias("error_message"))
