"""Catalog: evaluation metrics and gates, metric joins (JON6, JON8), SCL16."""

from __future__ import annotations

from pyspark.sql import functions as F

from looplake.config import DEFAULT
from looplake.functions import scalars as S
from looplake.operators import evaluate as E
from looplake.operators import jobs as J
from looplake.operators import trainset as TS
from looplake.plans.catalog_scope import SCOPED_SQL, WIN_SQL, strip_sql
from looplake.plans.catalog_state import _JOB_SCOPE_SQL
from looplake.plans.catalog_train import MIX_SQL, _frame, _scoped_eligible
from looplake.plans.registry import query
from looplake.sources.fixtures import SEED

C = DEFAULT


def metrics_sql(conf: str, by: str = "") -> str:
    """DuckDB text: accuracy / weighted F1 / macro F1 from a confusion CTE (by..., y, yhat, n)."""
    g = f"{by}, " if by else ""
    on = " AND ".join([f"a.{c.strip()} = b.{c.strip()}" for c in by.split(",")]) if by else "TRUE"
    return f"""
sup_{conf} AS (SELECT {g}y AS label, sum(n) AS support FROM {conf} GROUP BY ALL),
prd_{conf} AS (SELECT {g}yhat AS label, sum(n) AS predicted FROM {conf} GROUP BY ALL),
tp_{conf} AS (SELECT {g}y AS label, sum(n) AS tp FROM {conf} WHERE y = yhat GROUP BY ALL),
pc_{conf} AS (
  SELECT {", ".join(f"COALESCE(s.{c.strip()}, p.{c.strip()}) AS {c.strip()}" for c in by.split(",")) + ", " if by else ""}
         COALESCE(s.label, p.label) AS label, COALESCE(support, 0) AS support, COALESCE(predicted, 0) AS predicted,
         COALESCE(t.tp, 0) AS tp
  FROM sup_{conf} s FULL OUTER JOIN prd_{conf} p ON s.label = p.label {"".join(f" AND s.{c.strip()} = p.{c.strip()}" for c in by.split(",")) if by else ""}
  LEFT JOIN tp_{conf} t ON t.label = COALESCE(s.label, p.label) {"".join(f" AND t.{c.strip()} = COALESCE(s.{c.strip()}, p.{c.strip()})" for c in by.split(",")) if by else ""}),
f1_{conf} AS (
  SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM (
    SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS pr,
              CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rc FROM pc_{conf})),
m_{conf} AS (
  SELECT {"a." + ", a.".join(c.strip() for c in by.split(",")) + ", " if by else ""}a.accuracy, a.n, b.f1_weighted, b.f1_macro FROM
    (SELECT {g}CAST(sum(CASE WHEN y = yhat THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS accuracy, sum(n) AS n
     FROM {conf} GROUP BY ALL) a
  JOIN (SELECT {g}sum(support * f1) / sum(support) AS f1_weighted, avg(f1) AS f1_macro FROM f1_{conf} GROUP BY ALL) b
  ON {on})"""


SCORED_CONF = f"""
conf AS (SELECT 'production' AS model, {strip_sql('y')} AS y, {strip_sql('y_old')} AS yhat, count(*) AS n FROM fx_scored GROUP BY ALL
         UNION ALL
         SELECT 'staging', {strip_sql('y')}, {strip_sql('y_new')}, count(*) FROM fx_scored GROUP BY ALL)"""


def _pairs(fx):
    s = fx.scored
    return (s.select(F.lit("production").alias("model"), "y", F.col("y_old").alias("yhat"))
            .unionByName(s.select(F.lit("staging").alias("model"), "y", F.col("y_new").alias("yhat"))))


@query("confusion_matrix", f"WITH {SCORED_CONF} SELECT model, y, yhat, n FROM conf")
def _confusion_matrix(fx):
    return E.confusion_matrix(_pairs(fx), "y", "yhat", ["model"])


@query("accuracy", f"WITH {SCORED_CONF}, {metrics_sql('conf', 'model')} SELECT model, accuracy FROM m_conf")
def _accuracy(fx):
    return E.classification_metrics(_pairs(fx), "y", "yhat", ["model"]).select("model", "accuracy")


@query("weighted_f1", f"WITH {SCORED_CONF}, {metrics_sql('conf', 'model')} "
                      "SELECT model, round(f1_weighted, 9) AS f1_weighted FROM m_conf")
def _weighted_f1(fx):
    m = E.classification_metrics(_pairs(fx), "y", "yhat", ["model"])
    return m.select("model", F.round("f1_weighted", 9).alias("f1_weighted"))


@query("macro_f1", f"WITH {SCORED_CONF}, {metrics_sql('conf', 'model')} "
                   "SELECT model, round(f1_macro, 9) AS f1_macro FROM m_conf")
def _macro_f1(fx):
    m = E.classification_metrics(_pairs(fx), "y", "yhat", ["model"])
    return m.select("model", F.round("f1_macro", 9).alias("f1_macro"))


_BRIER_SQL = """
WITH k AS (SELECT count(DISTINCT target_diagnosis) AS k FROM fx_baseline),
cls AS (SELECT DISTINCT target_diagnosis AS label FROM fx_baseline),
p AS (SELECT s.row_id, s.y, c.label, CASE WHEN c.label = s.y_new THEN s.maxp ELSE (1 - s.maxp) / (k.k - 1) END AS p
      FROM fx_scored s CROSS JOIN cls c CROSS JOIN k)
SELECT round(avg(row_b), 9) AS brier FROM (
  SELECT row_id, sum(power((CASE WHEN label = y THEN 1.0 ELSE 0.0 END) - p, 2)) AS row_b FROM p GROUP BY row_id)"""


@query("multiclass_brier", _BRIER_SQL)
def _multiclass_brier(fx):
    classes = fx.baseline.agg(F.sort_array(F.collect_set("target_diagnosis")).alias("classes"))
    s = fx.scored.crossJoin(F.broadcast(classes))
    k = F.size("classes")
    probs = F.transform("classes", lambda c: F.when(c == F.col("y_new"), F.col("maxp"))
                        .otherwise((1 - F.col("maxp")) / (k - 1)))
    s = s.withColumn("proba", F.map_from_arrays(F.col("classes"), probs))
    return E.multiclass_brier(s, "y", "proba").select(F.round("brier", 9).alias("brier"))


_SWEEP_SQL = f"""
WITH maj AS (SELECT y AS maj FROM fx_scored GROUP BY y ORDER BY count(*) DESC, y LIMIT 1),
th AS (SELECT round(0.05 + 0.01 * i, 2) AS t FROM range(91) r(i)),
base_conf AS (SELECT {strip_sql('y')} AS y, {strip_sql('y_new')} AS yhat, count(*) AS n FROM fx_scored GROUP BY ALL),
t_conf AS (SELECT t, {strip_sql('y')} AS y, CASE WHEN maxp >= t THEN {strip_sql('y_new')} ELSE maj END AS yhat, count(*) AS n
           FROM fx_scored, th, maj GROUP BY ALL),
{metrics_sql('base_conf')},
{metrics_sql('t_conf', 't')},
better AS (SELECT m_t_conf.t, m_t_conf.f1_weighted, round(m_t_conf.f1_weighted, 12) AS f12 FROM m_t_conf, m_base_conf b
           WHERE round(m_t_conf.f1_weighted, 12) > round(b.f1_weighted, 12)),
best AS (SELECT min(t) AS t, max(f1_weighted) AS f FROM better WHERE f12 = (SELECT max(f12) FROM better))
SELECT COALESCE(best.t, 0.5) AS best_threshold, round(COALESCE(best.f, b.f1_weighted), 9) AS best_f1_weighted,
       round(b.f1_weighted, 9) AS base_f1
FROM m_base_conf b LEFT JOIN best ON TRUE"""


@query("confidence_threshold_sweep", _SWEEP_SQL)
def _confidence_threshold_sweep(fx):
    s = fx.scored
    maj = TS.majority_class(s, "y")
    out = E.confidence_threshold_sweep(s.crossJoin(F.broadcast(maj)), "y", "y_new", "maxp", "majority_label")
    return out.select("best_threshold", F.round("best_f1_weighted", 9).alias("best_f1_weighted"),
                      F.round("base_f1", 9).alias("base_f1"))


_GOLD = "golden AS (SELECT s.* FROM fx_scored s)"


@query("regression_gate", f"""
WITH {MIX_SQL}, {_GOLD},
nf AS (SELECT count(*) AS n FROM frame WHERE scope_key = 'global:GLOBAL' AND source = 'feedback'),
bconf AS (SELECT {strip_sql('y')} AS y, {strip_sql('y_old')} AS yhat, count(*) AS n FROM golden GROUP BY ALL),
nconf AS (SELECT {strip_sql('y')} AS y, {strip_sql('y_new')} AS yhat, count(*) AS n FROM golden GROUP BY ALL),
{metrics_sql('bconf')}, {metrics_sql('nconf')}
SELECT b.n AS golden_test_size, round(b.f1_weighted, 9) AS base_f1, round(n.f1_weighted, 9) AS new_f1,
       b.accuracy AS base_acc, n.accuracy AS new_acc,
       CASE WHEN b.f1_weighted >= {C.regression_high_baseline} THEN greatest({C.regression_tolerance}, {C.regression_high_tolerance})
            ELSE {C.regression_tolerance} END AS effective_tolerance,
       nf.n >= {C.regression_min_feedback} AS gate_enabled,
       NOT (nf.n >= {C.regression_min_feedback}) OR n.f1_weighted >= b.f1_weighted -
         CASE WHEN b.f1_weighted >= {C.regression_high_baseline} THEN greatest({C.regression_tolerance}, {C.regression_high_tolerance})
              ELSE {C.regression_tolerance} END AS passed
FROM m_bconf b, m_nconf n, nf""")
def _regression_gate(fx):
    golden = E.golden_set(fx.scored)
    nf = _frame(fx).where((F.col("scope_key") == "global:GLOBAL") & (F.col("source") == "feedback")).agg(
        F.count(F.lit(1)).alias("_nf"))
    b = E.regression_gate(golden, "y", "y_old", "y_new", F.lit(0))
    # the feedback count is a one-row aggregate joined in (no driver round trip)
    out = b.crossJoin(nf)
    enabled = F.col("_nf") >= C.regression_min_feedback
    return out.select("golden_test_size", F.round("base_f1", 9).alias("base_f1"), F.round("new_f1", 9).alias("new_f1"),
                      "base_acc", "new_acc", "effective_tolerance", enabled.alias("gate_enabled"),
                      (~enabled | (F.col("new_f1") >= F.col("base_f1") - F.col("effective_tolerance"))).alias("passed"))


_FB_PRED = """
fo AS (SELECT m.*, CASE WHEN id % 7 = 0 THEN 'click' ELSE label END AS base_pred,
              CASE WHEN id % 9 = 0 THEN 'view' ELSE label END AS new_pred FROM fbo m)"""


@query("feedback_gate", f"""
WITH {SCOPED_SQL},
fb AS (SELECT * FROM scoped WHERE is_training_eligible AND created_at >= {WIN_SQL}),
pp2 AS (SELECT CAST(id AS VARCHAR) AS tid, arg_min(prediction_input, created_at) AS pin FROM fx_prediction_log
        WHERE id IS NOT NULL GROUP BY 1),
m2 AS (SELECT fb.scope_key, fb.id, fb.final_diagnosis AS label, COALESCE(fb.data_quality_score, 1.0) AS quality
       FROM fb JOIN pp2 ON CAST(fb.prediction_id AS VARCHAR) = pp2.tid),
thr2 AS (SELECT scope_key, greatest(0.5, quantile_cont(quality, 0.25)) AS threshold FROM m2 GROUP BY scope_key),
fbo AS (SELECT m2.* FROM m2 JOIN thr2 ON m2.scope_key = thr2.scope_key WHERE quality >= threshold),
{_FB_PRED},
bconf AS (SELECT scope_key, {strip_sql('label')} AS y, {strip_sql('base_pred')} AS yhat, count(*) AS n FROM fo GROUP BY ALL),
nconf AS (SELECT scope_key, {strip_sql('label')} AS y, {strip_sql('new_pred')} AS yhat, count(*) AS n FROM fo GROUP BY ALL),
{metrics_sql('bconf', 'scope_key')}, {metrics_sql('nconf', 'scope_key')},
k AS (SELECT scope_key, count(DISTINCT {strip_sql('label')}) AS k FROM fo GROUP BY scope_key)
SELECT b.scope_key, CASE WHEN k.k < 2 THEN 'accuracy' ELSE 'f1_weighted' END AS metric, b.n AS feedback_eval_size,
       round(CASE WHEN k.k < 2 THEN b.accuracy ELSE b.f1_weighted END, 9) AS base_score,
       round(CASE WHEN k.k < 2 THEN n.accuracy ELSE n.f1_weighted END, 9) AS new_score,
       CASE WHEN k.k < 2 THEN n.accuracy >= b.accuracy - {C.feedback_gate_tolerance}
            ELSE n.f1_weighted >= b.f1_weighted - {C.feedback_gate_tolerance} END AS passed
FROM m_bconf b JOIN m_nconf n ON b.scope_key = n.scope_key JOIN k ON b.scope_key = k.scope_key""")
def _feedback_gate(fx):
    fo = TS.feedback_only_frame(_scoped_eligible(fx), fx.prediction_log)
    fo = (fo.withColumn("base_pred", F.when(F.col("id") % 7 == 0, F.lit("click")).otherwise(F.col("label")))
          .withColumn("new_pred", F.when(F.col("id") % 9 == 0, F.lit("view")).otherwise(F.col("label"))))
    g = E.feedback_gate(fo, "label", "base_pred", "new_pred", by=["scope_key"])
    return g.select("scope_key", "metric", "feedback_eval_size", F.round("base_score", 9).alias("base_score"),
                    F.round("new_score", 9).alias("new_score"), "passed")


@query("promotion_guardrail", f"""
WITH d AS (SELECT {_JOB_SCOPE_SQL} AS scope_key, training_id, n_samples, cv_mean_f1_weighted, cv_std_f1_weighted
           FROM fx_job WHERE lower(status) = 'completed' AND COALESCE(is_deployed, FALSE)),
l AS (SELECT *, lag(cv_mean_f1_weighted) OVER (PARTITION BY scope_key ORDER BY training_id) AS baseline_metric FROM d),
c AS (SELECT *, list_filter([
        CASE WHEN COALESCE(n_samples, 0) < {C.promote_min_samples}
             THEN 'n_samples=' || CAST(COALESCE(n_samples, 0) AS INTEGER) || ' < PROMOTE_MIN_SAMPLES={C.promote_min_samples}' END,
        CASE WHEN cv_mean_f1_weighted IS NULL THEN 'cv_mean_f1_weighted is missing'
             WHEN baseline_metric IS NOT NULL AND cv_mean_f1_weighted - baseline_metric < {C.promote_min_delta}
             THEN 'cv_mean_f1_weighted_delta=' || printf('%.4f', cv_mean_f1_weighted - baseline_metric)
                  || ' < PROMOTE_MIN_PRIMARY_METRIC_DELTA={C.promote_min_delta:.4f}' END], lambda x: x IS NOT NULL) AS checks
      FROM l)
SELECT scope_key, training_id, round(cv_mean_f1_weighted - baseline_metric, 9) AS delta, len(checks) = 0 AS passed,
       CASE WHEN len(checks) = 0 THEN 'passed' ELSE array_to_string(checks, '; ') END AS reason
FROM c""")
def _promotion_guardrail(fx):
    d = J.job_deltas(fx.job).join(fx.job.select("training_id", "n_samples", "cv_std_f1_weighted"), "training_id")
    d = d.withColumnRenamed("metric", C.promote_primary_metric)
    g = E.promotion_guardrail(d)
    return g.select("scope_key", "training_id", F.round(f"{C.promote_primary_metric}_delta", 9).alias("delta"),
                    "passed", "reason")


@query("champion_challenger", f"""
WITH s AS (SELECT {strip_sql('y')} AS y, {strip_sql('y_new')} AS yhat, count(*) AS n FROM fx_scored GROUP BY ALL),
p AS (SELECT {strip_sql('y')} AS y, {strip_sql('y_old')} AS yhat, count(*) AS n FROM fx_scored GROUP BY ALL),
{metrics_sql('s')}, {metrics_sql('p')}
SELECT s.accuracy AS staging_accuracy, round(s.f1_weighted, 9) AS staging_f1, p.accuracy AS production_accuracy,
       round(p.f1_weighted, 9) AS production_f1, s.accuracy - p.accuracy AS accuracy_gain,
       round(s.f1_weighted - p.f1_weighted, 9) AS f1_gain, s.accuracy - p.accuracy > 0.01 AS accuracy_gain_ok,
       s.f1_weighted >= 0.85 AS f1_score_min_ok,
       CASE WHEN s.accuracy - p.accuracy > 0.01 AND s.f1_weighted >= 0.85 THEN 'APPROVE'
            WHEN s.f1_weighted >= 0.85 THEN 'CONSIDER' ELSE 'REJECT' END AS recommendation
FROM m_s s, m_p p""")
def _champion_challenger(fx):
    c = E.champion_challenger(fx.scored, "y", "y_new", "y_old")
    return c.select("staging_accuracy", F.round("staging_f1", 9).alias("staging_f1"), "production_accuracy",
                    F.round("production_f1", 9).alias("production_f1"), "accuracy_gain",
                    F.round("f1_gain", 9).alias("f1_gain"), "accuracy_gain_ok", "f1_score_min_ok", "recommendation")


@query("recommendation", f"""
WITH p AS (SELECT {_JOB_SCOPE_SQL} AS scope_key, training_id, validation_f1 AS f1,
                  validation_f1 - lag(validation_f1) OVER (PARTITION BY {_JOB_SCOPE_SQL} ORDER BY training_id) AS gain
           FROM fx_job WHERE lower(status) = 'completed')
SELECT training_id, CASE WHEN gain > 0.01 AND f1 >= 0.85 THEN 'APPROVE' WHEN f1 >= 0.85 THEN 'CONSIDER' ELSE 'REJECT' END
         AS recommendation
FROM p""")
def _recommendation(fx):
    d = fx.job.where(F.lower("status") == "completed").withColumn("scope_key", J.job_scope_key())
    l = J.lag_by(d.select("scope_key", "training_id", "validation_f1"), ["scope_key"], "training_id", ["validation_f1"])
    return l.select("training_id", S.recommendation(F.col("validation_f1") - F.col("prev_validation_f1"),
                                                    F.col("validation_f1")).alias("recommendation"))


@query("class_weight_lookup", f"""
WITH {MIX_SQL},
cw AS (SELECT label, CAST((SELECT count(*) FROM fx_baseline) AS DOUBLE)
                     / ((SELECT count(DISTINCT target_diagnosis) FROM fx_baseline) * count(*)) AS class_weight
       FROM (SELECT CAST(target_diagnosis AS VARCHAR) AS label FROM fx_baseline) GROUP BY label)
SELECT f.label, count(*) AS n, round(max(COALESCE(cw.class_weight, 1.0)), 9) AS class_weight
FROM frame f LEFT JOIN cw ON f.label = cw.label GROUP BY f.label""")
def _class_weight_lookup(fx):
    cw = TS.balanced_class_weights(fx.baseline)
    f = _frame(fx).join(F.broadcast(cw), "label", "left")
    return f.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                  F.round(F.max(F.coalesce("class_weight", F.lit(1.0))), 9).alias("class_weight"))


@query("metric_baseline_join", f"""
WITH runs AS (SELECT {_JOB_SCOPE_SQL} AS scope_key, training_id, new_model_version, cv_mean_f1_weighted
              FROM fx_job WHERE lower(status) = 'completed'),
prevv AS (SELECT *, lag(new_model_version) OVER (PARTITION BY scope_key ORDER BY training_id) AS baseline_version FROM runs),
vm AS (SELECT scope_key, new_model_version AS version, arg_max_null(cv_mean_f1_weighted, training_id) AS baseline_metric
       FROM runs GROUP BY ALL)
SELECT p.scope_key, p.training_id, p.baseline_version, vm.baseline_metric
FROM prevv p LEFT JOIN vm ON p.scope_key = vm.scope_key AND p.baseline_version = vm.version""")
def _metric_baseline_join(fx):
    runs = (fx.job.where(F.lower("status") == "completed").withColumn("scope_key", J.job_scope_key())
            .select("scope_key", "training_id", "new_model_version", "cv_mean_f1_weighted"))
    prev = J.lag_by(runs, ["scope_key"], "training_id", ["new_model_version"]).withColumnRenamed(
        "prev_new_model_version", "baseline_version")
    vm = runs.groupBy("scope_key", F.col("new_model_version").alias("version")).agg(
        F.max_by("cv_mean_f1_weighted", "training_id").alias("baseline_metric"))
    j = prev.join(vm, (prev["scope_key"] == vm["scope_key"]) & (prev["baseline_version"] == vm["version"]), "left")
    return j.select(prev["scope_key"], "training_id", "baseline_version", "baseline_metric")
