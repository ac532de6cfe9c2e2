"""Monitoring over a prediction log (prediction, actual?, confidence, latency, ts).

Order is ``(ts, event_id)``.  ``actual`` NULL means unlabelled.  Every metric
covers the whole log it is given, or a stated time window of it; a caller who
wants recent rows only filters by ``ts``.  Running metrics use the distributed
ordering helpers, never an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from looplake.functions import scalars as S
from looplake.operators import ordering as O
from looplake.operators.scope import _ts
from looplake.session import cut_lineage

ORDER = ("ts", "event_id")
# Histogram bucket bounds of the reference's metrics.
CONFIDENCE_BUCKETS = (0.2, 0.4, 0.6, 0.8, 0.9, 0.95, 1.0)
LATENCY_BUCKETS = (0.1, 0.3, 0.5, 1, 2, 5, 10)
TRAINING_DURATION_BUCKETS = (1, 3, 5, 10, 20, 30, 60, 120, 300, 600)
# Health rule thresholds.
ACCURACY_WARN = 0.7
CONFIDENCE_WARN = 0.6
VOLUME_INFO = 1
ERROR_CRITICAL = 0.3
ERROR_WARN = 0.2
LOW_CONFIDENCE_ALERT = 0.3
BURST_WINDOW = 10
BURST_MIN_ERRORS = 5


def labelled() -> Column:
    return F.col("actual").isNotNull()


def correct() -> Column:
    return labelled() & (F.col("prediction") == F.col("actual"))


def wrong() -> Column:
    return labelled() & (F.col("prediction") != F.col("actual"))


def monitor_metrics(log: DataFrame, as_of) -> DataFrame:
    """total, correct, accuracy (correct / rows up to the last labelled row), avg confidence,
    predictions in the last hour and error rate."""
    key = F.struct(F.col("ts"), F.col("event_id"))
    life = log.agg(F.count(F.lit(1)).alias("total_predictions"),
                   F.count_if(correct()).alias("correct_predictions"),
                   F.max(F.when(labelled(), key)).alias("_last_lab"))
    upto = (log.join(F.broadcast(life.select("_last_lab")), key <= F.col("_last_lab"), "inner")
            .agg(F.count(F.lit(1)).alias("_n_at_label")))
    h = log.agg(
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(F.col("ts") > _ts(as_of) - F.expr("INTERVAL 1 HOUR")).alias("predictions_per_hour"),
        F.count_if(wrong()).alias("_wrong"), F.count_if(labelled()).alias("_lab"))
    j = life.crossJoin(upto).crossJoin(h)
    return j.select(
        "total_predictions", "correct_predictions",
        F.when(F.col("_last_lab").isNull() | (F.col("_n_at_label") == 0), F.lit(0.0))
        .otherwise(F.col("correct_predictions") / F.col("_n_at_label")).alias("accuracy"),
        F.coalesce(F.col("avg_confidence"), F.lit(0.0)).alias("avg_confidence"),
        "predictions_per_hour",
        F.when(F.col("_lab") > 0, F.col("_wrong") / F.col("_lab")).otherwise(F.lit(0.0)).alias("error_rate"))


def confidence_stats(log: DataFrame) -> DataFrame:
    a = log.agg(F.min("confidence").alias("min"), F.max("confidence").alias("max"),
                F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("std"))
    median = O.quantile(log.select("confidence"), "confidence", 0.5)
    return a.crossJoin(F.broadcast(median)).select("min", "max", F.col("quantile").alias("median"), "std")  # one row each


def prediction_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def recent_accuracy(log: DataFrame, as_of, hours: int = 24) -> DataFrame:
    h = log.where(F.col("ts") > _ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return h.agg(F.count(F.lit(1)).alias("recent_24h_predictions"), F.count_if(correct()).alias("_c"),
                 F.count_if(labelled()).alias("_l")).select(
        F.when(F.col("_l") > 0, F.col("_c") / F.col("_l")).otherwise(F.lit(0.0)).alias("recent_24h_accuracy"),
        "recent_24h_predictions")


def hourly_trend(log: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Per clock hour in the last ``hours`` (at least 1): n, accuracy over labelled rows (0.0 without
    labels), average confidence, error_rate = 1 − accuracy."""
    if hours < 1:
        raise ValueError("hours must be at least 1")
    h = log.where(F.col("ts") > _ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))
    g = h.groupBy(S.iso_hour_key("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(correct()).alias("_c"), F.count_if(labelled()).alias("_l"),
        F.avg("confidence").alias("avg_confidence"))
    acc = F.when(F.col("_l") > 0, F.col("_c") / F.col("_l")).otherwise(F.lit(0.0))
    return g.select("hour", "predictions", acc.alias("accuracy"), "avg_confidence", (1.0 - acc).alias("error_rate"))


def cumulative_histogram(df: DataFrame, col: str, bounds, by: list | None = None) -> DataFrame:
    """Prometheus-style cumulative buckets (le = bound, plus +Inf) with sum and count."""
    by = list(by or [])
    aggs = [F.count_if(F.col(col) <= float(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    a = df.where(F.col(col).isNotNull()).groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("count"),
                                                          F.sum(col).alias("sum"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return a.select(*by, F.explode(F.array(*pairs)).alias("p"), "sum", "count").select(
        *by, "p.le", "p.bucket_count", "sum", "count")


def requests_by_clinic_status(log: DataFrame, status: Column) -> DataFrame:
    return log.groupBy(F.coalesce(F.col("clinic_id"), F.lit("global")).alias("clinic_id"),
                       status.alias("status")).agg(F.count(F.lit(1)).alias("requests"))


def low_confidence_alerts(log: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return log.where(c < LOW_CONFIDENCE_ALERT).select(
        "event_id", "ts", "prediction", F.lit("low_confidence").alias("type"),
        F.concat(F.lit("Very low confidence: "), S.py_fixed(c, 2)).alias("message"))


def error_burst_alerts(log: DataFrame, block: int = O.DEFAULT_BLOCK) -> DataFrame:
    """A wrong prediction with >= 5 wrong among the last 10 rows (itself included)."""
    n = O.with_row_number(log.select("event_id", "ts", "prediction", "actual"), list(ORDER), "rn")
    s = O.trailing_sum(n, "rn", wrong().cast("int"), BURST_WINDOW, "recent_errors", block=block)
    return s.where(wrong() & (F.col("recent_errors") >= BURST_MIN_ERRORS)).select(
        "event_id", "ts", F.lit("high_error_rate").alias("type"), "recent_errors",
        F.format_string(f"High error rate detected: %d/{BURST_WINDOW} recent predictions",
                        F.col("recent_errors")).alias("message"))


def asof_count_before(df: DataFrame, seconds: int, rn: str = "rn") -> DataFrame:
    """For each row (numbered by ``rn`` in (ts, event_id) order): number of rows with
    ts <= row.ts − seconds.  Shifted copies are merged into the sequence and counted with a
    distributed running total (no range window over a single task)."""
    shifted = df.select((F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))).alias("ts"),
                        F.col("event_id"), F.lit(0).alias("_kind"))
    probes = df.select("ts", "event_id", F.lit(1).alias("_kind"))
    u = O.with_row_number(shifted.unionByName(probes), ["ts", "_kind", "event_id"], "_u")
    t = O.running_totals(u, "_u", {"_before": (F.col("_kind") == 0).cast("long")})
    return df.join(t.where(F.col("_kind") == 1).select("event_id", "_before"), "event_id")


def running_monitor(log: DataFrame, block: int = O.DEFAULT_BLOCK) -> DataFrame:
    """Metrics as they stood after each event: one numbering and one pass of running values."""
    n = cut_lineage(O.with_row_number(log.select("event_id", "ts", "prediction", "actual", "confidence"), list(ORDER), "rn"))
    # confidences are summed as DECIMAL(38,9), so the result does not depend on the summation
    # order of the blocks; one final double division
    r = O.running_totals(
        n, "rn", {"correct_so_far": correct().cast("long"), "_csum": F.col("confidence").cast("decimal(38,9)"),
                  "_ccnt": F.col("confidence").isNotNull().cast("long"), "_w": wrong().cast("long"), "_l": labelled().cast("long")},
        block=block, maxima={"_last_lab": F.when(labelled(), F.col("rn")).otherwise(F.lit(0))})
    r = r.join(asof_count_before(n.select("event_id", "ts"), 3600).select("event_id", "_before"), "event_id")
    return r.select(
        "event_id", "ts", F.col("rn").alias("total_predictions"), F.col("correct_so_far").alias("correct_predictions"),
        F.when(F.col("_last_lab") > 0, F.col("correct_so_far") / F.col("_last_lab")).otherwise(F.lit(0.0))
        .alias("accuracy"),
        F.round(F.try_divide(F.col("_csum").cast("double"), F.col("_ccnt").cast("double")), 9).alias("avg_confidence"),
        (F.col("rn") - F.col("_before")).alias("predictions_per_hour"),
        F.when(F.col("_l") > 0, F.col("_w") / F.col("_l")).otherwise(F.lit(0.0)).alias("error_rate"))


def model_health(metrics: DataFrame) -> DataFrame:
    """Health checks from one metrics row; only the error rate moves ``overall_health``."""
    acc, conf, vol, err = (F.col("accuracy"), F.col("avg_confidence"), F.col("predictions_per_hour"),
                           F.col("error_rate"))

    def chk(cond, name, status, msg):
        return F.when(cond, F.struct(F.lit(name).alias("name"), F.lit(status).alias("status"), msg.alias("message")))

    checks = F.array_compact(F.array(
        chk(acc < ACCURACY_WARN, "Accuracy Check", "warning",
            F.concat(F.lit("Accuracy "), S.py_fixed(acc, 2), F.lit(f" below threshold {ACCURACY_WARN}"))),
        chk(conf < CONFIDENCE_WARN, "Confidence Check", "warning",
            F.concat(F.lit("Average confidence "), S.py_fixed(conf, 2), F.lit(f" below threshold {CONFIDENCE_WARN}"))),
        chk(vol < VOLUME_INFO, "Prediction Volume", "info",
            F.concat(F.lit("Low prediction volume: "), S.py_fixed(vol, 1), F.lit(" per hour"))),
        chk(err > ERROR_CRITICAL, "Error Rate", "critical", F.concat(F.lit("High error rate: "), S.py_fixed(err, 2))),
        chk((err <= ERROR_CRITICAL) & (err > ERROR_WARN), "Error Rate", "warning",
            F.concat(F.lit("Elevated error rate: "), S.py_fixed(err, 2))),
    ))
    overall = (F.when(err > ERROR_CRITICAL, F.lit("critical")).when(err > ERROR_WARN, F.lit("warning"))
               .otherwise(F.lit("healthy")))
    return metrics.select(overall.alias("overall_health"), F.explode_outer(checks).alias("c")).select(
        "overall_health", "c.name", "c.status", "c.message")


def retrain_score(metrics: DataFrame, drift_score: Column | float = 0.0, min_samples: int = 100,
                  accuracy_threshold: float = 0.7, max_error_rate: float = 0.3) -> DataFrame:
    """Retraining eligibility score (note: good accuracy raises the score, as in the reference)."""
    d = drift_score if isinstance(drift_score, Column) else F.lit(float(drift_score))
    acc, err = F.col("accuracy"), F.col("error_rate")
    q = F.least(F.lit(1.0), F.col("total_predictions") / float(min_samples))
    p0 = (F.when(acc >= accuracy_threshold, F.lit(1.0))
          .when(acc > 0.5, (acc - 0.5) / (accuracy_threshold - 0.5)).otherwise(F.lit(0.0)))
    p = F.when(err > max_error_rate, p0 * 0.5).otherwise(p0)
    overall = q * 0.3 + p * 0.5 + d * 0.2
    eligible = (overall >= 0.6) & (q >= 0.5)
    reasons = F.array_compact(F.array(
        F.when(q < 0.5, F.format_string(f"Insufficient data (%d < {min_samples})", F.col("total_predictions"))),
        F.when(acc < accuracy_threshold, F.concat(F.lit("Low accuracy ("), S.py_fixed(acc, 2), F.lit(f" < {accuracy_threshold})"))),
        F.when(err > max_error_rate, F.concat(F.lit("High error rate ("), S.py_fixed(err, 2), F.lit(f" > {max_error_rate})"))),
        F.when(d > 0.5, F.lit("Data drift detected"))))
    reasons = F.when((F.size(reasons) == 0) & eligible, F.array(F.lit("Model performance meets retraining criteria"))) \
        .otherwise(reasons)
    return metrics.select(q.alias("data_quality_score"), p.alias("performance_score"), d.alias("drift_score"),
                          overall.alias("overall_score"), eligible.alias("eligible"),
                          F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(F.lit("Not eligible"))
                          .alias("reason"))


def health_rollup(health: DataFrame, retrain: DataFrame, reference_ready: bool = True) -> DataFrame:
    """Model / Drift / Eligibility checks with a warning/critical roll-up."""
    model = health.select(F.lit("Model Performance").alias("name"), F.col("overall_health").alias("status")).limit(1)
    drift = retrain.select(F.lit("Data Drift").alias("name"),
                           (F.when(F.col("drift_score") > 0.5, F.lit("warning")).otherwise(F.lit("ok"))
                            if reference_ready else F.lit("not_configured")).alias("status"))
    elig = retrain.select(F.lit("Training Eligibility").alias("name"),
                          F.when(F.col("eligible"), F.lit("ready")).otherwise(F.lit("not_ready")).alias("status"))
    checks = model.unionByName(drift).unionByName(elig)
    roll = checks.agg(F.when(F.bool_or(F.col("status") == "critical"), F.lit("critical"))
                      .when(F.bool_or(F.col("status").isin("warning", "critical")), F.lit("warning"))
                      .otherwise(F.lit("healthy")).alias("overall_status"))
    return checks.crossJoin(roll)


def alert_counts(alerts: DataFrame) -> DataFrame:
    resolved = F.col("resolved") if "resolved" in alerts.columns else F.lit(False)
    return alerts.agg(F.count_if(~F.coalesce(resolved, F.lit(False))).alias("active_alerts"),
                      F.count(F.lit(1)).alias("total_alerts"))


def drift_alert_rule(drift: DataFrame, score_col: str = "drift_score") -> DataFrame:
    s = F.col(score_col)
    return drift.select("*", F.when(s > 0.5, F.lit("warning")).alias("severity"),
                        F.when(s > 0.5, F.lit("Data drift detected (drift_score > 0.5)")).alias("alert_message"))


def recent_tail(df: DataFrame, n: int, order=ORDER) -> DataFrame:
    """Last ``n`` rows by order, returned oldest first (bounded top-k then a sort of n rows)."""
    top = df.orderBy(*[F.desc(c) for c in order]).limit(int(n))
    return top.orderBy(*order)
