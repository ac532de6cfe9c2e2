"""Evaluation metrics and promotion gates over scored rows.

All metrics start from the confusion counts ``groupBy(y, ŷ)`` (tiny: classes²
rows per group), so scoring billions of rows costs one partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from looplake.config import DEFAULT, Config
from looplake.functions import scalars as S


def confusion_matrix(df: DataFrame, y: str, yhat: str, by: list | None = None, count_col: str | None = None
                     ) -> DataFrame:
    """Counts per (y, ŷ); ``count_col`` sums pre-aggregated counts instead of counting rows."""
    by = list(by or [])
    cnt = F.sum(count_col) if count_col else F.count(F.lit(1))
    return (df.select(*by, S.normalize_label(y).alias("y"), S.normalize_label(yhat).alias("yhat"),
                      *([F.col(count_col)] if count_col else []))
            .groupBy(*by, "y", "yhat").agg(cnt.alias("n")))


def per_class_f1(conf: DataFrame, by: list | None = None) -> DataFrame:
    """Per class (labels ∪ predictions): support, precision, recall, F1 with zero_division = 0.

    Each confusion cell contributes one row to its true class (support, true positives) and
    one to its predicted class (predicted count), so a single aggregation yields all three."""
    by = list(by or [])
    n = F.col("n").cast("long")
    zero = F.lit(0).cast("long")
    cells = conf.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("label"), n.alias("support"),
                 F.when(F.col("y") == F.col("yhat"), n).otherwise(zero).alias("tp"), zero.alias("predicted")),
        F.struct(F.col("yhat").alias("label"), zero.alias("support"), zero.alias("tp"), n.alias("predicted")),
    )).alias("c"))
    agg = cells.groupBy(*by, F.col("c.label").alias("label")).agg(
        F.sum("c.support").alias("support"), F.sum("c.predicted").alias("predicted"), F.sum("c.tp").alias("tp"))
    tpc, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    prec = F.when(p > 0, tpc / p).otherwise(F.lit(0.0))
    rec = F.when(s > 0, tpc / s).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return agg.select(*by, "label", "support", "predicted", "tp", prec.alias("precision"), rec.alias("recall"),
                      f1.alias("f1"))


def classification_metrics(df: DataFrame, y: str, yhat: str, by: list | None = None,
                           count_col: str | None = None) -> DataFrame:
    """accuracy, weighted F1 (support-weighted over true classes), macro F1 (labels ∪ predictions), n.
    Three aggregations in a chain: confusion cells -> per-class counts -> per-group metrics."""
    by = list(by or [])
    pc = per_class_f1(confusion_matrix(df, y, yhat, by, count_col), by)
    return pc.groupBy(*by).agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                               F.sum("support").alias("n"),
                               (F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("f1_weighted"),
                               F.avg("f1").alias("f1_macro"))


def multiclass_brier(df: DataFrame, y: str, proba: str, by: list | None = None) -> DataFrame:
    """mean over rows of Σ_k (1[y=k] − p_k)²; ``proba`` is a map label -> probability.
    A label outside the model's classes contributes Σ p_k²."""
    by = list(by or [])
    m, lab = F.col(proba), S.normalize_label(y)
    sq = F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, p: acc + p * p)
    row = sq - 2 * F.coalesce(F.element_at(m, lab), F.lit(0.0)) + F.when(F.map_contains_key(m, lab), 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.avg(row).alias("brier"))


def threshold_table(spark, start: float = 0.05, step: float = 0.01, count: int = 91) -> DataFrame:
    """The 91 thresholds 0.05 .. 0.95 (two decimals) — derived from a rule, not listed."""
    return spark.range(count).select(F.col("id").cast("int").alias("i"),
                                     F.round(F.lit(start) + F.lit(step) * F.col("id"), 2).alias("t"))


def confidence_threshold_sweep(df: DataFrame, y: str, yhat: str, maxp: str, majority: Column | str,
                               by: list | None = None) -> DataFrame:
    """Below threshold t predict the majority label.  Start from t = 0.5 with the plain weighted
    F1; keep the first strictly better t.  Rows are first reduced to (y, ŷ, threshold bin)
    counts, then crossed with the 91-row threshold table."""
    by = list(by or [])
    spark = df.sparkSession
    th = threshold_table(spark)
    maj = F.col(majority) if isinstance(majority, str) else majority
    # bin = number of thresholds <= maxp  (prediction kept for those thresholds)
    b = F.least(F.lit(91), F.greatest(F.lit(0), F.floor(F.round((F.col(maxp) - 0.05) * 100, 6)) + 1)).cast("int")
    red = (df.select(*by, S.normalize_label(y).alias("y"), S.normalize_label(yhat).alias("yhat"),
                     S.normalize_label(maj).alias("maj"), b.alias("bin"))
           .groupBy(*by, "y", "yhat", "maj", "bin").agg(F.count(F.lit(1)).alias("n")))
    crossed = red.crossJoin(F.broadcast(th)).withColumn(
        "pred", F.when(F.col("i") < F.col("bin"), F.col("yhat")).otherwise(F.col("maj")))
    per_t = classification_metrics(crossed, "y", "pred", by + ["t"], count_col="n")
    base = classification_metrics(df, y, yhat, by).select(*by, F.col("f1_weighted").alias("base_f1"))
    j = per_t.join(base, by, "inner") if by else per_t.crossJoin(base)
    # "strictly better" on values rounded to 12 places: equal prediction sets must compare equal
    # whatever the summation order of the F1 aggregate
    f12 = F.round("f1_weighted", 12)
    better = j.where(f12 > F.round("base_f1", 12)).withColumn("_f12", f12)
    best = better.groupBy(*by).agg(F.max("_f12").alias("_best"))
    first = (better.join(best, by, "inner") if by else better.crossJoin(best)).where(
        F.col("_f12") == F.col("_best")).groupBy(*by).agg(F.min("t").alias("_t"), F.max("f1_weighted").alias("_f"))
    out = base.join(first, by, "left") if by else base.join(first, F.lit(True), "left")
    return out.select(*by, F.coalesce(F.col("_t"), F.lit(0.5)).alias("best_threshold"),
                      F.coalesce(F.col("_f"), F.col("base_f1")).alias("best_f1_weighted"), "base_f1")


def regression_gate(golden: DataFrame, y: str, base_pred: str, new_pred: str, n_feedback: Column,
                    cfg: Config = DEFAULT, fine_tune: bool = True) -> DataFrame:
    """Golden-set gate: fail when new F1 < base F1 − tolerance (tolerance widened when the base is
    near perfect); skipped for small feedback batches or without fine-tuning."""
    b = classification_metrics(golden, y, base_pred).select(F.col("f1_weighted").alias("base_f1"),
                                                            F.col("accuracy").alias("base_acc"),
                                                            F.col("n").alias("golden_test_size"))
    nw = classification_metrics(golden, y, new_pred).select(F.col("f1_weighted").alias("new_f1"),
                                                           F.col("accuracy").alias("new_acc"))
    tol = F.when(F.col("base_f1") >= cfg.regression_high_baseline,
                 F.greatest(F.lit(cfg.regression_tolerance), F.lit(cfg.regression_high_tolerance))).otherwise(
        F.lit(cfg.regression_tolerance))
    enabled = F.lit(fine_tune) & (n_feedback >= cfg.regression_min_feedback)
    return b.crossJoin(nw).select(
        "golden_test_size", "base_f1", "new_f1", "base_acc", "new_acc", tol.alias("effective_tolerance"),
        enabled.alias("gate_enabled"),
        (~enabled | (F.col("new_f1") >= F.col("base_f1") - tol)).alias("passed"))


def golden_set(baseline: DataFrame, share: float = 1.0, cfg: Config = DEFAULT, key: str = "row_id") -> DataFrame:
    """The baseline rows that gates evaluate: all, or a stated share by hash."""
    if share >= 1.0:
        return baseline
    return baseline.where(F.pmod(F.xxhash64(F.lit(cfg.seed), key), F.lit(1_000_000)) < int(share * 1_000_000))


def feedback_gate(frame: DataFrame, y: str, base_pred: str, new_pred: str, cfg: Config = DEFAULT,
                  by: list | None = None) -> DataFrame:
    """Accuracy when the feedback frame has one class, else weighted F1; fail if new < base − tol."""
    by = list(by or [])
    k = frame.groupBy(*by).agg(F.count_distinct(S.normalize_label(y)).alias("_k"))
    b = classification_metrics(frame, y, base_pred, by)
    nw = classification_metrics(frame, y, new_pred, by)
    j = (b.alias("b").join(nw.alias("n"), by, "inner").join(k, by, "inner") if by
         else b.alias("b").crossJoin(nw.alias("n")).crossJoin(k))
    single = F.col("_k") < 2
    base_sc = F.when(single, F.col("b.accuracy")).otherwise(F.col("b.f1_weighted"))
    new_sc = F.when(single, F.col("n.accuracy")).otherwise(F.col("n.f1_weighted"))
    return j.select(*by, F.when(single, F.lit("accuracy")).otherwise(F.lit("f1_weighted")).alias("metric"),
                    F.col("b.n").alias("feedback_eval_size"), base_sc.alias("base_score"), new_sc.alias("new_score"),
                    (new_sc >= base_sc - cfg.feedback_gate_tolerance).alias("passed"))


def promotion_guardrail(runs: DataFrame, cfg: Config = DEFAULT, metric: str | None = None) -> DataFrame:
    """Guardrail per run (needs n_samples, <metric>, baseline_metric, cv_std_f1_weighted).
    Reason = failed checks joined by '; ' or 'passed'."""
    m = metric or cfg.promote_primary_metric
    new, base = F.col(m), F.col("baseline_metric")
    delta = new - base
    fmt = lambda c: S.py_fixed(c, 4)
    checks = F.array_compact(F.array(
        F.when(F.coalesce(F.col("n_samples"), F.lit(0)) < cfg.promote_min_samples,
               F.format_string(f"n_samples=%d < PROMOTE_MIN_SAMPLES={cfg.promote_min_samples}",
                               F.coalesce(F.col("n_samples"), F.lit(0)).cast("int"))),
        F.when(new.isNull(), F.lit(f"{m} is missing"))
        .when(base.isNotNull() & (delta < cfg.promote_min_delta),
              F.concat(F.lit(f"{m}_delta="), fmt(delta),
                       F.lit(f" < PROMOTE_MIN_PRIMARY_METRIC_DELTA={cfg.promote_min_delta:.4f}")))
        .when(base.isNull() & F.lit(cfg.promote_require_baseline), F.lit(f"baseline {m} is missing")),
        F.when(F.lit(cfg.promote_max_cv_std < 100) & F.col("cv_std_f1_weighted").isNotNull()
               & (F.col("cv_std_f1_weighted") > cfg.promote_max_cv_std),
               F.concat(F.lit("cv_std_f1_weighted="), fmt(F.col("cv_std_f1_weighted")),
                        F.lit(f" > PROMOTE_MAX_CV_STD_F1_WEIGHTED={cfg.promote_max_cv_std:.4f}"))),
    ))
    passed = F.size(checks) == 0
    return runs.withColumn(f"{m}_delta", F.when(new.isNotNull() & base.isNotNull(), delta)).withColumn(
        "passed", passed).withColumn("reason", F.when(passed, F.lit("passed")).otherwise(F.array_join(checks, "; ")))


def champion_challenger(df: DataFrame, y: str, staging: str, production: str, min_gain: float = 0.01,
                        min_f1: float = 0.85) -> DataFrame:
    """Staging vs production on one test set: metrics, gains, pass flags and recommendation."""
    s = classification_metrics(df, y, staging).select(F.col("accuracy").alias("staging_accuracy"),
                                                      F.col("f1_weighted").alias("staging_f1"))
    p = classification_metrics(df, y, production).select(F.col("accuracy").alias("production_accuracy"),
                                                         F.col("f1_weighted").alias("production_f1"))
    j = s.crossJoin(p)
    gain = F.col("staging_accuracy") - F.col("production_accuracy")
    return j.select("*", gain.alias("accuracy_gain"), (F.col("staging_f1") - F.col("production_f1")).alias("f1_gain"),
                    (gain > min_gain).alias("accuracy_gain_ok"), (F.col("staging_f1") >= min_f1).alias("f1_score_min_ok"),
                    S.recommendation(gain, F.col("staging_f1"), min_gain, min_f1).alias("recommendation"))


def training_metrics_row(metrics: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """All metrics of a run as one row plus a JSON document of them."""
    cols = [F.col(c) for c in metrics.columns] + [v.alias(k) for k, v in (extra or {}).items()]
    return metrics.select(*cols).withColumn("training_metrics_json", F.to_json(F.struct(*cols)))
