"""Feedback scoping, filters, projections, joins and scope-level counts.

Scope rule: GLOBAL-pool feedback counts for the global scope without any join;
CLINIC_ONLY feedback counts for the clinic of its prediction.  Where the
reference answers one scope per call, these functions answer every scope in
one pass (``groupBy(scope_key)``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looplake.config import DEFAULT, FEATURES, Config
from looplake.functions import scalars as S

PREDICTION_COLUMNS = ("id", "visit_id", "pet_id", "prediction_input", "prediction_output", "model_version",
                      "confidence_score", "top_k_predictions", "veterinarian_id", "clinic_id", "created_at")


def _ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        return F.lit(as_of).cast("timestamp")
    return F.lit(as_of).cast("timestamp")


def window_start(as_of, days: int) -> Column:
    return _ts(as_of) - F.make_dt_interval(F.lit(int(days)))


# ---------------------------------------------------------------- sources
def scan_predictions(predictions: DataFrame, clinic_id: str | None = None) -> DataFrame:
    """The 11 stored columns, optionally one clinic (exact text match)."""
    df = predictions.select(*[c for c in PREDICTION_COLUMNS if c in predictions.columns])
    if clinic_id is not None:
        df = df.where(F.col("clinic_id") == F.lit(clinic_id))
    return df


def scan_feedback(feedback: DataFrame, predictions: DataFrame | None = None, *, eligible_only: bool = False,
                  days: int | None = None, clinic_id: str | None = None, id_min: int | None = None,
                  id_max: int | None = None, as_of=None) -> DataFrame:
    """Scoped feedback read; ``created_at`` is exposed as ``timestamp``, pool not projected."""
    f = feedback.alias("f")
    if clinic_id is None:
        df = f.where(F.col("f.training_pool") == "GLOBAL")
    else:
        p = predictions.select(F.col("id").alias("p_id"), F.col("clinic_id").alias("p_clinic_id"))
        df = (f.join(p, F.col("f.prediction_id") == F.col("p_id"), "inner")
              .where((F.col("p_clinic_id") == F.lit(clinic_id)) & (F.col("f.training_pool") == "CLINIC_ONLY")))
    if eligible_only:
        df = df.where(F.col("f.is_training_eligible") == F.lit(True))
    if days is not None:
        df = df.where(F.col("f.created_at") >= window_start(as_of, days))
    if id_min is not None:
        df = df.where(F.col("f.id") >= F.lit(int(id_min)))
    if id_max is not None:
        df = df.where(F.col("f.id") <= F.lit(int(id_max)))
    keep = [c for c in ("id", "prediction_id", "final_diagnosis", "is_correct", "ai_diagnosis", "confidence_rating",
                        "comments", "veterinarian_id", "is_training_eligible", "data_quality_score")
            if c in feedback.columns]
    return df.select(*[F.col(f"f.{c}").alias(c) for c in keep], F.col("f.created_at").alias("timestamp"))


# ---------------------------------------------------------------- scope tagging
def feedback_scopes(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Tag every feedback row with its scope (``scope_key``, ``scope_clinic``).

    GLOBAL rows need no prediction; CLINIC_ONLY rows take the (normalized)
    clinic of their prediction and drop out when it has none.  One shuffle
    join on the prediction id (unique on both sides, so no skew).
    """
    p = predictions.select(F.col("id").alias("_pid"), S.normalize_clinic_key("clinic_id").alias("_pclinic"))
    j = feedback.join(p, feedback["prediction_id"] == p["_pid"], "left")
    is_global = F.col("training_pool") == "GLOBAL"
    is_clinic = (F.col("training_pool") == "CLINIC_ONLY") & F.col("_pclinic").isNotNull()
    return (j.where(is_global | is_clinic)
            .withColumn("scope_clinic", F.when(is_global, F.lit(None).cast("string")).otherwise(F.col("_pclinic")))
            .withColumn("scope_key", F.when(is_global, F.lit("global:GLOBAL"))
                        .otherwise(F.concat(F.lit("clinic:"), F.col("_pclinic"), F.lit(":CLINIC_ONLY"))))
            .drop("_pid", "_pclinic"))


def eligible_filter(df: DataFrame, col: str = "is_training_eligible") -> DataFrame:
    """Eligible rows; a missing flag counts as eligible."""
    if col not in df.columns:
        return df
    return df.where(F.coalesce(F.col(col), F.lit(True)))


def window_days_filter(df: DataFrame, as_of, days: int, col: str = "created_at") -> DataFrame:
    return df.where(F.col(col) >= window_start(as_of, days))


def pool_scope_filter(feedback: DataFrame, predictions: DataFrame, clinic_id: str | None = None) -> DataFrame:
    """Feedback of one scope: GLOBAL pool (no join) or one clinic's CLINIC_ONLY rows."""
    if clinic_id is None:
        return feedback.where(F.col("training_pool") == "GLOBAL")
    p = (predictions.where(F.col("clinic_id").isNotNull() & (F.trim(F.col("clinic_id")) != ""))
         .where(F.col("clinic_id") == F.lit(clinic_id)).select(F.col("id").alias("_pid")))
    return (feedback.where(F.col("training_pool") == "CLINIC_ONLY")
            .join(p, feedback["prediction_id"] == p["_pid"], "left_semi"))


def id_range_filter(feedback: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id lies in [min, max] of ``ids`` and is a member of it.

    The bounds are a one-row aggregate (broadcast); membership is a semi join,
    which Spark turns into a broadcast or shuffle join depending on size.
    """
    bounds = ids.agg(F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi"))
    ranged = (feedback.crossJoin(F.broadcast(bounds))
              .where(F.col(id_col).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi"))
    return ranged.join(ids.select(F.col(id_col).alias("_mid")).distinct(),
                       F.col(id_col) == F.col("_mid"), "left_semi")


def allowlist_filter(df: DataFrame, ids: DataFrame, col: str = "id", ids_col: str = "id") -> DataFrame:
    """Keep rows whose id (as text) is in the allow-list; null ids never match."""
    allow = ids.select(F.col(ids_col).cast("string").alias("_aid")).where(F.col("_aid").isNotNull()).distinct()
    return df.join(allow, F.col(col).cast("string") == F.col("_aid"), "left_semi")


def label_nonempty(df: DataFrame, col: str) -> DataFrame:
    return df.where(S.strip(F.col(col).cast("string")) != "")


def scopes_in_cooldown(state: DataFrame, as_of) -> DataFrame:
    return state.where(F.col("cooldown_until").isNotNull() & (F.col("cooldown_until") > _ts(as_of)))


# ---------------------------------------------------------------- projections
FEATURE_SCHEMA = T.StructType([
    T.StructField("animal_type", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age_months", T.IntegerType()),
    T.StructField("weight_kg", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("heart_rate", T.IntegerType()),
    T.StructField("current_season", T.StringType()),
    T.StructField("vaccination_status", T.StringType()),
    T.StructField("medical_history", T.StringType()),
    T.StructField("symptom_duration", T.IntegerType()),
    T.StructField("symptoms_list", T.StringType()),
])


def parse_features(df: DataFrame, json_col: str = "prediction_input", out: str = "_input") -> DataFrame:
    """The prediction input JSON as a column of its own, for ``feature_columns``: eleven fields taken from
    ``from_json`` in one projection are eleven parsers, each over the whole text."""
    return df.withColumn(out, F.from_json(F.col(json_col), FEATURE_SCHEMA))


def feature_columns(parsed: str = "_input") -> list[Column]:
    """The 11 typed feature columns out of the parsed prediction input."""
    out = []
    for f in FEATURES:
        c = F.col(parsed)[f]
        if f == "medical_history":
            c = F.coalesce(c, F.lit("Unknown"))
        elif f == "symptoms_list":
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f))
    return out


def extract_features(predictions: DataFrame, keep=("id",)) -> DataFrame:
    return parse_features(predictions).select(*[F.col(k) for k in keep], *feature_columns())


def stored_diagnosis(predictions: DataFrame) -> DataFrame:
    return predictions.select("id", S.stored_diagnosis("prediction_output", "top_k_predictions").alias("stored_label"))


def resolve_clinic(predictions: DataFrame) -> DataFrame:
    return predictions.select("id", S.resolve_clinic("clinic_id", "prediction_input").alias("resolved_clinic_id"))


def resolve_pool(feedback: DataFrame, predictions: DataFrame, policy: DataFrame,
                 explicit_col: str | None = "training_pool") -> DataFrame:
    """Pool for each feedback row: explicit valid value, else GLOBAL for a prediction without a
    clinic, else the clinic's policy (invalid/absent -> CLINIC_ONLY).  Policy is a small
    dimension keyed by clinic; the join strategy is left to AQE."""
    p = predictions.select(F.col("id").alias("_pid"), S.normalize_clinic_key("clinic_id").alias("_clinic"))
    pol = policy.select(S.strip("clinic_id").alias("_pol_clinic"), F.upper(F.col("feedback_pool")).alias("_pol"))
    j = (feedback.join(p, feedback["prediction_id"] == p["_pid"], "left")
         .join(pol, F.col("_clinic") == F.col("_pol_clinic"), "left"))
    explicit = F.col(explicit_col) if explicit_col else F.lit(None).cast("string")
    policy_pool = F.when(F.col("_pol").isin("GLOBAL", "CLINIC_ONLY"), F.col("_pol")).otherwise(F.lit("CLINIC_ONLY"))
    pool = (F.when(explicit.isin("GLOBAL", "CLINIC_ONLY"), explicit)
            .when(F.col("_clinic").isNull(), F.lit("GLOBAL"))
            .otherwise(policy_pool))
    return j.select(F.col("id"), F.col("prediction_id"), F.col("_clinic").alias("prediction_clinic_id"),
                    pool.alias("resolved_pool"))


def policy_lookup(clinics: DataFrame, policy: DataFrame, clinic_col: str = "clinic_id") -> DataFrame:
    """Pool per clinic: stored policy upper-cased if valid, else CLINIC_ONLY; blank clinic -> CLINIC_ONLY."""
    pol = policy.select(S.strip("clinic_id").alias("_pc"), F.upper(F.col("feedback_pool")).alias("_pol"))
    c = clinics.select(S.strip(clinic_col).alias(clinic_col)).distinct()
    return (c.join(pol, F.col(clinic_col) == F.col("_pc"), "left")
            .select(clinic_col, F.when((F.col(clinic_col) != "") & F.col("_pol").isin("GLOBAL", "CLINIC_ONLY"),
                                       F.col("_pol")).otherwise(F.lit("CLINIC_ONLY")).alias("feedback_pool")))


def feedback_validate(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Row-level feedback checks; the AI label comes from the stored prediction when absent."""
    stored = stored_diagnosis(predictions).withColumnRenamed("id", "_pid")
    j = feedback.join(stored, feedback["prediction_id"] == stored["_pid"], "left")
    final = S.blank_to_null("final_diagnosis")
    ai = F.coalesce(S.blank_to_null("ai_diagnosis"), F.col("stored_label"))
    same = F.lower(final) == F.lower(ai)
    violations = F.array_compact(F.array(
        F.when(final.isNull(), F.lit("final_diagnosis_required")),
        F.when(ai.isNotNull() & final.isNotNull() & F.col("is_correct") & ~same, F.lit("invalid_accept")),
        F.when(ai.isNotNull() & final.isNotNull() & ~F.col("is_correct") & same, F.lit("invalid_reject")),
        F.when(F.col("confidence_rating").isNotNull() & ~F.col("confidence_rating").between(0, 5),
               F.lit("rating_out_of_range")),
        F.when(F.col("data_quality_score").isNotNull() & ~F.col("data_quality_score").between(0.0, 1.0),
               F.lit("quality_out_of_range")),
        F.when(F.col("training_pool").isNotNull() & ~F.col("training_pool").isin("GLOBAL", "CLINIC_ONLY"),
               F.lit("invalid_pool")),
    ))
    outcome = (F.when(F.array_contains(violations, "invalid_accept"), F.lit("invalid_accept"))
               .when(F.array_contains(violations, "invalid_reject"), F.lit("invalid_reject"))
               .when(F.size(violations) > 0, F.lit("invalid"))
               .otherwise(F.lit("ok")))
    return j.select("id", "prediction_id", ai.alias("effective_ai_diagnosis"),
                    F.array_join(violations, ",").alias("violations"), outcome.alias("outcome"))


def scope_annotation(jobs: DataFrame) -> DataFrame:
    """training_scope = 'clinic' when the job has a non-blank clinic, else 'global'."""
    return jobs.withColumn("training_scope", F.when(S.normalize_clinic_key("clinic_id").isNull(), F.lit("global"))
                           .otherwise(F.lit("clinic")))


def training_snapshot(batch_feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Feedback rows joined to their prediction (last duplicate id wins), 7 feedback + 11 raw feature columns."""
    p = (predictions.select(F.col("id").cast("string").alias("_pid"),
                            F.struct(F.col("created_at"), F.col("prediction_input")).alias("_v"))
         .groupBy("_pid").agg(F.max_by("_v", "_v.created_at").alias("_v")))
    j = batch_feedback.join(p, batch_feedback["prediction_id"].cast("string") == p["_pid"], "inner")
    j = parse_features(j, "_v.prediction_input")
    raw = F.col("_input")
    ts = F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return j.select("prediction_id", ts.alias("timestamp"), "final_diagnosis", "ai_diagnosis", "is_correct",
                    "confidence_rating", "data_quality_score", *[raw[f].alias(f) for f in FEATURES])


# ---------------------------------------------------------------- joins
def feedback_join_predictions(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    p = predictions.select(F.col("id").alias("p_id"), F.col("clinic_id").alias("p_clinic_id"),
                           F.col("prediction_input"), F.col("created_at").alias("p_created_at"))
    return feedback.join(p, feedback["prediction_id"] == p["p_id"], "inner")


def dedup_predictions_by_text_id(predictions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One prediction per text id (first in created_at order wins, like a first-match scan).

    Only ``columns`` travel through the aggregation; its output is hash-partitioned by the
    text id, which the following join on that id reuses (no second shuffle)."""
    cols = list(columns or predictions.columns)
    if "created_at" not in cols:
        cols.append("created_at")
    return (predictions.withColumn("_tid", F.col("id").cast("string")).where(F.col("_tid").isNotNull())
            .groupBy("_tid").agg(F.min_by(F.struct(*[F.col(c) for c in cols]),
                                          F.struct(F.col("created_at"), F.col("id"))).alias("_p"))
            .select("_tid", "_p.*"))


def feedback_match_text_id(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Equi-join on the text form of the ids (null ids never match)."""
    p = dedup_predictions_by_text_id(predictions, ["prediction_input", "created_at"]).select(
        "_tid", F.col("prediction_input"), F.col("created_at").alias("p_created_at"))
    f = feedback.where(F.col("prediction_id").isNotNull())
    return f.join(p, f["prediction_id"].cast("string") == p["_tid"], "inner").drop("_tid")


def orphan_feedback(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    p = predictions.select(F.col("id").cast("string").alias("_tid")).where(F.col("_tid").isNotNull())
    return feedback.join(p, feedback["prediction_id"].cast("string") == p["_tid"], "left_anti")


def null_safe_scope_join(scopes: DataFrame, jobs: DataFrame, scope_clinic_col: str = "scope_clinic") -> DataFrame:
    """Scopes with a running job whose clinic is NOT DISTINCT FROM the scope clinic."""
    running = jobs.where(F.col("status") == "running").select(F.col("clinic_id").alias("_jc"))
    return scopes.join(running, scopes[scope_clinic_col].eqNullSafe(F.col("_jc")), "left_semi")


# ---------------------------------------------------------------- counts
def prediction_counts(predictions: DataFrame) -> DataFrame:
    """Total plus per-clinic counts in one pass (grouping sets)."""
    g = predictions.groupBy(F.col("clinic_id")).agg(F.count(F.lit(1)).alias("n"))
    per = g.select(F.lit("clinic").alias("level"), "clinic_id", F.col("n").alias("prediction_count"))
    tot = g.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("prediction_count")).select(
        F.lit("total").alias("level"), F.lit(None).cast("string").alias("clinic_id"), "prediction_count")
    return per.unionByName(tot)


def feedback_counts(scoped: DataFrame, as_of, days: int) -> DataFrame:
    """Per scope: all rows, eligible, in window, eligible in window (one aggregation)."""
    elig = F.col("is_training_eligible") == F.lit(True)
    inwin = F.col("created_at") >= window_start(as_of, days)
    return scoped.groupBy("scope_key").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(elig).alias("eligible"),
        F.count_if(inwin).alias("in_window"),
        F.count_if(elig & inwin).alias("eligible_in_window"))


def feedback_by_correct(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("is_correct").agg(F.count(F.lit(1)).alias("n"))


def _eligible_clinic_rows(feedback: DataFrame, predictions: DataFrame, as_of, days: int) -> DataFrame:
    f = feedback.where((F.col("training_pool") == "CLINIC_ONLY") & (F.col("is_training_eligible") == F.lit(True))
                       & (F.col("created_at") >= window_start(as_of, days))).select("prediction_id")
    p = (predictions.where(F.col("clinic_id").isNotNull() & (F.trim(F.col("clinic_id")) != ""))
         .select(F.col("id").alias("_pid"), S.strip("clinic_id").alias("clinic_id")))
    return f.join(p, f["prediction_id"] == p["_pid"], "inner")


def eligible_by_clinic(feedback: DataFrame, predictions: DataFrame, as_of, days: int) -> DataFrame:
    """Eligible CLINIC_ONLY feedback per clinic within the window (blank clinics excluded)."""
    return (_eligible_clinic_rows(feedback, predictions, as_of, days)
            .groupBy("clinic_id").agg(F.count(F.lit(1)).alias("eligible_feedback_count"))
            .orderBy(F.desc("eligible_feedback_count"), F.asc("clinic_id")))


def infer_single_clinic(feedback: DataFrame, predictions: DataFrame, as_of, days: int) -> DataFrame:
    """The clinic iff exactly one distinct clinic has eligible CLINIC_ONLY feedback, else NULL."""
    rows = _eligible_clinic_rows(feedback, predictions, as_of, days)
    per = rows.groupBy("clinic_id").agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.count(F.lit(1)).alias("n_clinics"), F.min("clinic_id").alias("_c")).select(
        "n_clinics", F.when(F.col("n_clinics") == 1, F.col("_c")).alias("clinic_id"))


def max_feedback_id_by_scope(scoped: DataFrame) -> DataFrame:
    return scoped.groupBy("scope_key").agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("max_feedback_id"))


def audit_snapshot(scoped_eligible: DataFrame, window_days: int) -> DataFrame:
    """Per scope: accept / reject counts, total, accept ratio (0.0 without rows)."""
    a = scoped_eligible.groupBy("scope_key", "scope_clinic").agg(
        F.count(F.lit(1)).alias("eligible_feedback_total"),
        F.count_if(F.col("is_correct") == F.lit(True)).alias("feedback_accept_count"),
        F.count_if(F.col("is_correct") == F.lit(False)).alias("feedback_reject_count"))
    return a.select(
        "scope_key", F.when(F.col("scope_clinic").isNull(), F.lit("global")).otherwise(F.lit("clinic")).alias("scope"),
        F.col("scope_clinic").alias("clinic_id"), F.lit(int(window_days)).alias("training_window_days"),
        "eligible_feedback_total", "feedback_accept_count", "feedback_reject_count",
        F.when(F.col("eligible_feedback_total") > 0,
               F.col("feedback_accept_count") / F.col("eligible_feedback_total")).otherwise(F.lit(0.0))
        .alias("feedback_accept_ratio"))
