"""Catalog: features, forests, scoring, TOP3, EVA11, TRN6-8, PRJ8."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from looplake.config import CATEGORICAL_FEATURES, DEFAULT, FEATURES, NUMERIC_FEATURES
from looplake.functions import scalars as S
from looplake.operators import calibration as CA
from looplake.operators import crossval as CV
from looplake.operators import evaluate as E
from looplake.operators import features as FE
from looplake.operators import forests as FO
from looplake.operators import models as MD
from looplake.operators import scope as SC
from looplake.operators import trainset as TS
from looplake.plans import training_plan as TP
from looplake.plans.catalog_scope import SCOPED_SQL, WIN_SQL, WS, blank_null_sql, strip_sql
from looplake.plans.catalog_state import BATCHES_SQL, _JOB_SCOPE_SQL
from looplake.plans.catalog_train import MIX_SQL, _frame
from looplake.plans.registry import query
from looplake.session import cut_lineage
from looplake.sources.fixtures import AS_OF, AS_OF_SQL, SEED

C = DEFAULT
#: More than any forest's number of classes: scores keep them all.
ALL_CLASSES = 1 << 30


@query("scale_numeric", f"""
WITH {MIX_SQL},
st AS (SELECT scope_key, {", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in NUMERIC_FEATURES)}
       FROM frame GROUP BY scope_key)
{" UNION ALL ".join(f"SELECT f.scope_key, f.row_key, '{c}' AS feature, round((f.{c} - st.{c}_m) / CASE WHEN st.{c}_s IS NULL OR st.{c}_s = 0 THEN 1.0 ELSE st.{c}_s END, 9) AS scaled FROM frame f JOIN st ON f.scope_key = st.scope_key" for c in NUMERIC_FEATURES)}""")
def _scale_numeric(fx):
    out = FE.scale_numeric(_frame(fx), by=["scope_key"])
    return out.withColumn("scaled", F.round("scaled", 9))


_CAT_LONG = " UNION ALL ".join(f"SELECT scope_key, row_key, '{c}' AS feature, CAST({c} AS VARCHAR) AS category FROM frame"
                               for c in CATEGORICAL_FEATURES)


@query("one_hot_categories", f"""
WITH {MIX_SQL},
lng AS ({_CAT_LONG}),
slots AS (SELECT scope_key, feature, category, row_number() OVER (PARTITION BY scope_key, feature ORDER BY category) - 1 AS slot
          FROM (SELECT DISTINCT scope_key, feature, category FROM lng WHERE category IS NOT NULL))
SELECT l.scope_key, l.row_key, l.feature, CAST(s.slot AS INTEGER) AS slot
FROM lng l JOIN slots s ON l.scope_key = s.scope_key AND l.feature = s.feature AND l.category = s.category""")
def _one_hot_categories(fx):
    fr = _frame(fx)
    slots = FE.category_slots(fr, by=["scope_key"])
    return FE.one_hot_long(fr, slots, by=["scope_key"])


_TOKENS = (f"list_distinct(list_filter(list_transform(string_split(COALESCE(symptoms_list, ''), ','), "
           f"lambda x: lower({strip_sql('x')})), lambda x: x <> ''))")


@query("multi_hot_symptoms", f"""
WITH {MIX_SQL},
tok AS (SELECT scope_key, row_key, unnest({_TOKENS}) AS token FROM frame),
vocab AS (SELECT scope_key, token, row_number() OVER (PARTITION BY scope_key ORDER BY token) - 1 AS token_index
          FROM (SELECT DISTINCT scope_key, token FROM tok))
SELECT t.scope_key, t.row_key, CAST(v.token_index AS INTEGER) AS token_index
FROM tok t JOIN vocab v ON t.scope_key = v.scope_key AND t.token = v.token""")
def _multi_hot_symptoms(fx):
    fr = _frame(fx)
    vocab = FE.symptom_vocabulary(fr, by=["scope_key"])
    return FE.multi_hot_long(fr, vocab, by=["scope_key"])


# ------------------------------------------------------------------ model keys (rows-only)
def _train_setup(fx):
    """(number of encoded features, labels, training rows, validation rows, parameters) of the global scope."""
    fr = _frame(fx).where(F.col("scope_key") == "global:GLOBAL")
    frs = fr.join(fr.groupBy().agg(S.adaptive_split_ratio(F.count(F.lit(1))).alias("_r")), how="cross")
    # The split frame feeds several passes (encoder fit, vocabulary, forest iterations):
    # materialize it once in the shared checkpoint folder instead of recomputing the lineage.
    split = cut_lineage(TS.random_split(frs, F.col("_r"), SEED))
    fm = FE.fit_features(split)
    width = FE.assemble_features(fm, split.limit(1)).select(F.size(vector_to_array("features"))).first()[0]
    FE.assemble_features(fm, split).agg(F.max("label_idx")).collect()  # a row without a label is an error
    # class weights come from the baseline and weigh the training rows only
    weighted = TS.apply_class_weights(split.where(~F.col("is_validation")), TS.balanced_class_weights(fx.baseline))
    key = F.col("row_key").alias("key")
    train = FO._stored(FO.encode_rows(weighted.select("*", key), "scope_key", "key", "label", "weight"))
    valid = FO.encode_rows(split.where("is_validation").select("*", key), "scope_key", "key", "label")
    return width, list(fm.stages[-1].labels), train, valid, MD.forest_params(train, len(FEATURES))


@query("assemble_features", f"""
WITH {MIX_SQL},
sz AS (SELECT {len(NUMERIC_FEATURES)} + {" + ".join(f"count(DISTINCT {c})" for c in CATEGORICAL_FEATURES)}
              + (SELECT count(DISTINCT t) FROM (SELECT unnest({_TOKENS}) AS t FROM frame)) AS vector_size,
              {", ".join(f"avg({c}) AS m_{c}" for c in NUMERIC_FEATURES)} FROM frame)
SELECT f.scope_key, f.row_key, CAST(sz.vector_size AS INTEGER) AS vector_size,
       CAST({" + ".join(f"CASE WHEN {c} IS NULL OR abs({c} - m_{c}) > 1e-9 THEN 1 ELSE 0 END" for c in NUMERIC_FEATURES)}
            + {" + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in CATEGORICAL_FEATURES)}
            + len({_TOKENS}) AS INTEGER) AS non_zero
FROM frame f, sz""")
def _assemble_features(fx):
    """Encoded vectors: one row per frame row with the vector size and non-zero count."""
    fr = _frame(fx)
    fm = FE.fit_features(fr)
    enc = FE.assemble_features(fm, fr)
    arr = vector_to_array("features")
    return enc.select("scope_key", "row_key", F.size(arr).alias("vector_size"),
                      F.size(F.filter(arr, lambda x: F.isnan(x) | (F.abs(x) > 1e-9))).alias("non_zero"))


def _forest_setup(fx):
    """(training rows, validation rows, settings) of every scope, encoded for node-table forests."""
    fr = _frame(fx)
    ratio = fr.groupBy("scope_key").agg(S.adaptive_split_ratio(F.count(F.lit(1))).alias("_r"))
    split = cut_lineage(TS.random_split(fr.join(ratio, "scope_key"), F.col("_r"), SEED, by=["scope_key"]))
    train = TS.apply_class_weights(split.where(~F.col("is_validation")), TS.balanced_class_weights(fx.baseline))
    key = F.col("row_key").alias("key")
    train = FO.encode_rows(train.select("*", key), "scope_key", "key", "label", "weight")
    valid = FO.encode_rows(split.where("is_validation").select("*", key), "scope_key", "key", "row_key", "label")
    return train, valid, FO.scope_settings(train)


@query("train_forest")
def _train_forest(fx):
    """Validation predictions of every scope by its own weighted forest; all scopes are trained in one job."""
    train, valid, settings = _forest_setup(fx)
    nodes = FO.train_forests(train, settings)
    return FO.score(valid, nodes, settings, "scope_key", "row_key", "label") \
        .select("scope_key", "row_key", "label", "predicted_label", "confidence")


@query("warm_start_forest")
def _warm_start_forest(fx):
    """Every scope's forest with the fine-tune trees appended (or trained anew where its classes changed)."""
    train, valid, settings = _forest_setup(fx)
    base = FO.train_forests(train, settings)
    nodes, classes = FO.warm_start(base, settings.select("scope_key", "classes"), train, settings, C.fine_tune_extra_trees)
    return FO.score(valid, nodes, classes, "scope_key", "row_key", "label") \
        .select("scope_key", "row_key", "label", "predicted_label", "confidence")


@query("calibrate")
def _calibrate(fx):
    """Validation predictions of every scope by its forest after isotonic calibration on these rows."""
    train, valid, settings = _forest_setup(fx)
    nodes = FO.train_forests(train, settings)
    scored = FO._stored(FO.score(valid, nodes, settings, "scope_key", "key", "row_key", "label", top=ALL_CLASSES))
    pools = FO._stored(CA.fit_isotonic(scored, C.calibration_min_samples))
    return CA.apply_isotonic(scored, pools, "scope_key", "row_key", "label") \
        .select("scope_key", "row_key", "label", "predicted_label", "confidence", "calibrated")


@query("cross_validate")
def _cross_validate(fx):
    """Repeated stratified k-fold scores of every scope: mean and population std over its fits."""
    train, _, settings = _forest_setup(fx)
    return CV.cv_summary(CV.cross_validate(train, settings, C.cv_repeats, SEED), settings)


def _scored_log(fx, *keep):
    """The prediction log scored by saved forests: every tenant by its own, the others by the global one."""
    train, _, settings = _forest_setup(fx)
    folder, version = FO.new_folder(fx.spark), "v1"
    FO.save_forests(FO.train_forests(train, settings), settings, folder, version)
    nodes, classes = FO.load_forests(fx.spark, folder, version)
    features = (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES, "symptoms_list")
    rows = SC.extract_features(fx.prediction_log, keep=("id", "clinic_id", "created_at", "pet_id"))
    rows = FO.own_or_global(rows, S.normalize_clinic_key("clinic_id"), classes.select("scope_key"))
    rows = FO.encode_rows(rows.withColumn("key", F.col("id")), "scope_key", "key", "id", *keep, *(f for f in features if keep))
    return FO.score(rows, nodes, classes, "scope_key", "id", *keep, *(f for f in features if keep)) \
        .withColumn("model_version", F.concat_ws("/", F.lit(version), "scope_key"))


@query("batch_score")
def _batch_score(fx):
    """Every logged prediction re-scored by its tenant's effective model (label, confidence, top-3)."""
    return _scored_log(fx).select("id", "scope_key", "predicted_label", "confidence", F.to_json("top_k").alias("top_k"))


@query("score_to_log")
def _score_to_log(fx):
    """Scoring output shaped as prediction-log rows."""
    s = _scored_log(fx, "clinic_id", "created_at", "pet_id")
    return MD.score_to_log(s, F.col("model_version"), S.normalize_clinic_key("clinic_id"), F.col("created_at"))


@query("training_metrics_row")
def _training_metrics_row(fx):
    """One row of run metrics (accuracies, F1, Brier before and after calibration, threshold, cross
    validation, sizes, parameters) plus its JSON document."""
    width, labels, train, valid, params = _train_setup(fx)
    settings = FO._stored(FO.scope_settings(train).withColumns(
        {k: F.lit(v) for k, v in params.items()} | {"classes": F.array(*[F.lit(x) for x in labels])}))
    nodes = FO._stored(FO.train_forests(train, settings))

    def predicted(rows):
        share = F.map_from_entries("top_k")
        scored = FO.score(rows, nodes, settings, "label", top=ALL_CLASSES).select(
            "label", (F.array_position(lab, F.col("label")) - 1).cast("double").alias("label_idx"),
            F.transform(lab, lambda c: F.element_at(share, c)).alias("probability_arr"))
        return FO._stored(MD.with_prediction(scored, labels))

    lab = F.array(*[F.lit(x) for x in labels])
    tv = predicted(valid)
    # training rows are only counted: their labels suffice
    tt = FO.score(train, nodes, settings, "label", top=1)
    vm = E.classification_metrics(tv, "label", "predicted_label").select(
        F.col("accuracy").alias("validation_accuracy"), F.col("f1_weighted").alias("validation_f1"),
        F.col("f1_macro").alias("val_macro_f1"), F.col("n").alias("n_validation"))
    tm = E.classification_metrics(tt, "label", "predicted_label").select(
        F.col("accuracy").alias("training_accuracy"), F.col("n").alias("n_train"))

    def brier(df, name):
        return E.multiclass_brier(df.withColumn("_m", F.map_from_arrays(lab, F.col("probability_arr"))), "label", "_m") \
            .withColumnRenamed("brier", name)

    cal = MD.calibrate(tv, labels, min_rows=C.calibration_min_samples, method="sigmoid")
    after = brier(MD.apply_calibration(tv, cal), "brier_after")
    sweep = E.confidence_threshold_sweep(tv.crossJoin(F.broadcast(TS.majority_class(train, "label"))), "label", "predicted_label",
                                         "confidence", "majority_label").select(
        F.col("best_threshold").alias("confidence_threshold"), F.col("best_f1_weighted").alias("threshold_f1"))
    m = FO._stored(vm.crossJoin(tm).crossJoin(brier(tv, "brier_before")).crossJoin(after).crossJoin(sweep))
    cv = CV.cv_summary(CV.cross_validate(train, settings, C.cv_repeats, SEED), settings,
                       m.select(F.lit("global:GLOBAL").alias("scope_key"), "training_accuracy", "validation_f1"))
    m = m.crossJoin(cv.drop("scope_key").withColumnRenamed("status", "cv_status")).withColumn("n_samples", F.col("n_train") + F.col("n_validation"))
    extra = {k: F.lit(v) for k, v in params.items()} | {
        "calibration": F.lit("sigmoid" if cal else "skipped"), "split_mode": F.lit("random"),
        "n_classes": F.lit(len(labels)), "n_features": F.lit(width)}
    return E.training_metrics_row(m, extra)


# ------------------------------------------------------------------ TOP3, plans, job status (SQL)
@query("top3_classes", """
WITH cls AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx
             FROM (SELECT DISTINCT target_diagnosis AS label FROM fx_baseline)),
k AS (SELECT count(*) AS k FROM cls),
p AS (SELECT s.row_id, c.label, c.idx, CASE WHEN c.label = s.y_new THEN s.maxp ELSE (1 - s.maxp) / (k.k - 1) END AS prob
      FROM fx_scored s CROSS JOIN cls c CROSS JOIN k),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY prob DESC, idx DESC) AS rk FROM p)
SELECT row_id,
       max(CASE WHEN rk = 1 THEN label END) AS top1_label, round(max(CASE WHEN rk = 1 THEN prob END), 9) AS top1_prob,
       max(CASE WHEN rk = 2 THEN label END) AS top2_label, round(max(CASE WHEN rk = 2 THEN prob END), 9) AS top2_prob,
       max(CASE WHEN rk = 3 THEN label END) AS top3_label, round(max(CASE WHEN rk = 3 THEN prob END), 9) AS top3_prob
FROM r WHERE rk <= 3 GROUP BY row_id""")
def _top3_classes(fx):
    classes = fx.baseline.agg(F.sort_array(F.collect_set("target_diagnosis")).alias("classes"))
    s = fx.scored.crossJoin(F.broadcast(classes))
    k = F.size("classes")
    probs = F.transform("classes", lambda c: F.when(c == F.col("y_new"), F.col("maxp")).otherwise(
        (1 - F.col("maxp")) / (k - 1)))
    lab = F.col("classes")
    items = F.transform(probs, lambda p, i: F.struct(p.alias("prob"), i.alias("idx")))
    top = F.slice(F.sort_array(items, asc=False), 1, 3)
    out = s.select("row_id", lab.alias("_l"), top.alias("_t"))
    cols = []
    for i in range(3):
        cols += [F.element_at("_l", F.col("_t")[i]["idx"] + 1).alias(f"top{i + 1}_label"),
                 F.round(F.col("_t")[i]["prob"], 9).alias(f"top{i + 1}_prob")]
    return out.select("row_id", *cols)


_ELIG_GLOBAL = f"""(SELECT count(*) FROM fx_feedback WHERE training_pool = 'GLOBAL' AND is_training_eligible
                   AND created_at >= ({AS_OF_SQL} - INTERVAL {C.feedback_window_days} DAY))"""
_CLINIC_COUNTS = f"""
cc AS (SELECT trim(p.clinic_id) AS clinic_id, count(*) AS eligible_feedback_count
       FROM fx_feedback f JOIN fx_prediction_log p ON p.id = f.prediction_id
       WHERE f.training_pool = 'CLINIC_ONLY' AND f.is_training_eligible = TRUE
         AND f.created_at >= ({AS_OF_SQL} - INTERVAL {C.feedback_window_days} DAY)
         AND p.clinic_id IS NOT NULL AND trim(p.clinic_id) <> '' GROUP BY 1)"""


@query("training_plan", f"""
WITH {_CLINIC_COUNTS},
tg AS (SELECT * FROM cc WHERE eligible_feedback_count >= {C.min_feedback_for_training}),
g AS (SELECT {_ELIG_GLOBAL} AS eligible_feedback_count),
single AS (SELECT CASE WHEN count(*) = 1 THEN min(clinic_id) END AS rd FROM cc)
SELECT clinic_id AS scope, eligible_feedback_count, 'triggered_multi_clinic' AS decision, CAST(NULL AS VARCHAR) AS reason
FROM tg
UNION ALL
SELECT COALESCE(single.rd, 'global'), g.eligible_feedback_count,
       CASE WHEN g.eligible_feedback_count >= {C.min_feedback_for_training} THEN 'triggered' ELSE 'rejected' END,
       CASE WHEN g.eligible_feedback_count >= {C.min_feedback_for_training} THEN NULL
            ELSE 'Insufficient data: ' || g.eligible_feedback_count || ' < {C.min_feedback_for_training}' END
FROM g, single WHERE (SELECT count(*) FROM tg) = 0""")
def _training_plan(fx):
    return TP.training_plan(fx.feedback, fx.prediction_log, AS_OF)


@query("eligibility_check", f"""
WITH {_CLINIC_COUNTS},
clinics AS (SELECT DISTINCT {blank_null_sql('clinic_id')} AS clinic_id FROM fx_prediction_log
            WHERE {blank_null_sql('clinic_id')} IS NOT NULL),
allc AS (SELECT CAST(NULL AS VARCHAR) AS clinic_id, {_ELIG_GLOBAL} AS n
         UNION ALL SELECT c.clinic_id, COALESCE(cc.eligible_feedback_count, 0) FROM clinics c
         LEFT JOIN cc ON c.clinic_id = cc.clinic_id)
SELECT a.clinic_id, a.n AS eligible_feedback_count, {C.min_feedback_for_training} AS training_threshold,
       a.n >= {C.min_feedback_for_training} AS is_eligible_for_training,
       {C.feedback_window_days} AS training_window_days,
       CASE WHEN a.clinic_id IS NULL THEN 'global' ELSE 'clinic' END AS training_scope,
       CASE WHEN a.clinic_id IS NULL THEN NULL
            WHEN upper(p.feedback_pool) IN ('GLOBAL', 'CLINIC_ONLY') THEN upper(p.feedback_pool) ELSE 'CLINIC_ONLY' END
         AS clinic_feedback_pool_policy,
       {AS_OF_SQL} + INTERVAL 1 DAY AS next_check_date
FROM allc a LEFT JOIN fx_policy p ON a.clinic_id = {strip_sql('p.clinic_id')}""")
def _eligibility_check(fx):
    return TP.eligibility_check(fx.feedback, fx.prediction_log, fx.policy, AS_OF)


@query("auto_batch_plan", f"""
WITH {SCOPED_SQL},
cfg_as_of AS (SELECT 1),
cool AS (SELECT scope_key FROM fx_scope_state WHERE cooldown_until IS NOT NULL AND cooldown_until > {AS_OF_SQL}),
live AS (SELECT clinic_id, CASE WHEN status = 'running' AND start_time < {AS_OF_SQL} - INTERVAL 300 SECOND THEN 'failed'
                                ELSE status END AS status FROM fx_job),
scopes AS (SELECT DISTINCT scope_key, scope_clinic FROM scoped),
run AS (SELECT scope_key FROM scopes s
        WHERE EXISTS (SELECT 1 FROM live j WHERE j.status = 'running' AND j.clinic_id IS NOT DISTINCT FROM s.scope_clinic)),
{BATCHES_SQL.replace(f"{WIN_SQL}", f"({AS_OF_SQL} - INTERVAL {C.feedback_window_days} DAY)").replace(" = 10)", f" = {C.auto_batch_size})").replace("/ 10)", f"/ {C.auto_batch_size})")},
first AS (SELECT scope_key, list_sort(list(id)) AS ids FROM batches WHERE batch_no = 0 GROUP BY scope_key),
snap AS (SELECT b.scope_key, count(*) AS n FROM batches b JOIN fx_feedback f ON b.id = f.id
         WHERE b.batch_no = 0 AND CAST(f.prediction_id AS VARCHAR) IN (SELECT CAST(id AS VARCHAR) FROM fx_prediction_log)
         GROUP BY b.scope_key),
j AS (SELECT s.scope_key,
             CASE WHEN s.scope_key IN (SELECT scope_key FROM cool) THEN 'skip_cooldown'
                  WHEN s.scope_key IN (SELECT scope_key FROM run) THEN 'skip_running'
                  WHEN fi.ids IS NULL THEN 'skip_insufficient' ELSE 'create' END AS decision,
             fi.ids, sn.n
      FROM scopes s LEFT JOIN first fi ON s.scope_key = fi.scope_key LEFT JOIN snap sn ON s.scope_key = sn.scope_key)
SELECT scope_key, decision,
       CASE WHEN decision = 'create' THEN array_to_string(ids, ',') END AS batch_ids,
       CASE WHEN decision = 'create' THEN sha256('[' || array_to_string(ids, ',') || ']') END AS idempotency_key,
       CASE WHEN decision = 'create' THEN COALESCE(n, 0) END AS snapshot_rows
FROM j""")
def _auto_batch_plan(fx):
    return TP.auto_batch_plan(fx.feedback, fx.prediction_log, fx.scope_state, fx.job, AS_OF)


_METRICS_JSON = ("'{\"current_phase\":\"' || CASE WHEN training_id % 3 = 0 THEN 'model_train' ELSE 'validation' END"
                 " || '\",\"progress_pct\":' || (training_id % 100) || ',\"n_samples\":' || n_samples"
                 " || ',\"validation_f1\":' || validation_f1 || '}'")


@query("job_status", f"""
WITH jm AS (SELECT *, {_METRICS_JSON} AS training_metrics FROM fx_job),
req AS (SELECT training_id FROM fx_job UNION SELECT DISTINCT user_id + 1000000000 FROM events),
tot AS (SELECT (SELECT count(*) FROM fx_prediction_log) AS tp, {_ELIG_GLOBAL} AS ef)
SELECT r.training_id, COALESCE(j.status, 'pending') AS status,
       json_extract_string(j.training_metrics, '$.current_phase') AS current_phase,
       CAST(json_extract_string(j.training_metrics, '$.progress_pct') AS INTEGER) AS progress_pct,
       array_to_string(list_sort(list_filter(json_keys(j.training_metrics),
                                             lambda k: k NOT IN ('current_phase', 'progress_pct'))), ',') AS phase_metric_keys,
       CASE WHEN j.training_id IS NULL THEN tot.tp END AS total_predictions,
       CASE WHEN j.training_id IS NULL THEN tot.ef END AS eligible_feedback_count,
       CASE WHEN j.training_id IS NULL THEN 'Training job not found' END AS error_message
FROM req r LEFT JOIN jm j ON r.training_id = j.training_id CROSS JOIN tot""")
def _job_status(fx):
    from looplake.operators import jobs as J
    jm = fx.job.withColumn("training_metrics", F.expr(_METRICS_JSON))
    req = fx.job.select("training_id").unionByName(
        fx.table("events").select((F.col("user_id") + 1000000000).alias("training_id"))).distinct()
    return J.job_status(jm, req, fx.prediction_log, fx.feedback, AS_OF, C.feedback_window_days)
