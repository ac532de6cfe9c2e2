"""Distributed forests: training with tiered parameters, warm-start ensembles, isotonic
calibration, repeated stratified cross validation and per-tenant batch scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import (LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from looplake.config import DEFAULT, Config
from looplake.operators import evaluate as E
from looplake.operators import features as FE
from looplake.operators import ordering as O
from looplake.operators import trainset as TS
from looplake.session import cut_lineage


def forest_params(train: DataFrame, n_features: int, cfg: Config = DEFAULT) -> dict:
    """Tiered parameters from the training-row count (one small aggregate to the driver)."""
    row = train.agg(F.count(F.lit(1)).alias("n")).select(
        *TS.adaptive_forest_params(F.col("n"), F.lit(n_features), cfg)).first()
    return row.asDict()


def train_forest(train: DataFrame, params: dict, features_col: str = "features", label_col: str = "label_idx",
                 weight_col: str | None = "weight") -> RandomForestClassificationModel:
    """Weighted random forest.  ``min_samples_split`` has no Spark parameter (documented gap);
    depth is capped at Spark's limit of 30."""
    rf = RandomForestClassifier(featuresCol=features_col, labelCol=label_col, numTrees=int(params["n_estimators"]),
                                maxDepth=min(30, int(params["max_depth"])),
                                minInstancesPerNode=int(params["min_samples_leaf"]),
                                bootstrap=bool(params["bootstrap"]), seed=int(params["random_state"]),
                                featureSubsetStrategy="sqrt", maxBins=64)
    if weight_col:
        rf = rf.setWeightCol(weight_col)
    return rf.fit(train)


@dataclass
class ForestEnsemble:
    """Warm start without refitting old trees: soft voting over the old forest's n1 trees and a
    new forest's n2 trees is p = (n1·p1 + n2·p2) / (n1 + n2).  Both share the label index space
    of the old model's encoder."""
    models: list
    weights: list

    def probability(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        out = df
        cols = []
        for i, m in enumerate(self.models):
            m2 = m.copy().setFeaturesCol(features_col).setProbabilityCol(f"_p{i}").setPredictionCol(f"_y{i}") \
                .setRawPredictionCol(f"_r{i}")
            out = m2.transform(out).drop(f"_y{i}", f"_r{i}")
            cols.append(vector_to_array(F.col(f"_p{i}")))
        tot = float(sum(self.weights))

        def add(share: float):
            return lambda a, b: a + b * share

        acc = F.transform(cols[0], lambda x: x * (self.weights[0] / tot))
        for w, c in zip(self.weights[1:], cols[1:]):
            acc = F.zip_with(acc, c, add(w / tot))
        return out.withColumn("probability_arr", acc).drop(*[f"_p{i}" for i in range(len(self.models))])


def warm_start_forest(base: RandomForestClassificationModel, train: DataFrame, extra_trees: int, seed: int,
                      params: dict) -> ForestEnsemble:
    p = dict(params, n_estimators=max(1, int(extra_trees)), random_state=seed + 1)
    new = train_forest(train, p)
    return ForestEnsemble([base, new], [base.getNumTrees, new.getNumTrees])


def with_prediction(df: DataFrame, labels: list[str], prob_col: str = "probability_arr") -> DataFrame:
    """argmax label, confidence and top-3 {label, prob} (ties: higher class index first)."""
    lab = F.array(*[F.lit(x) for x in labels])
    items = F.transform(F.col(prob_col), lambda p, i: F.struct(p.alias("prob"), i.alias("idx")))
    ranked = F.sort_array(items, asc=False)
    top = F.slice(ranked, 1, 3)
    return df.select("*", F.element_at(lab, ranked[0]["idx"] + 1).alias("predicted_label"),
                     ranked[0]["prob"].alias("confidence"),
                     F.transform(top, lambda s: F.struct(F.element_at(lab, s["idx"] + 1).alias("label"),
                                                         s["prob"].alias("prob"))).alias("top_k"))


def calibrate(valid: DataFrame, labels: list[str], prob_col: str = "probability_arr", label_idx: str = "label_idx",
              min_rows: int = 50, method: str = "isotonic") -> list:
    """One regression per class on the validation rows, ``isotonic`` or ``sigmoid`` (logistic in the
    class probability); fewer than ``min_rows`` rows fit nothing: an empty list, which callers report
    as not calibrated."""
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"unknown calibration method {method!r}")
    if valid.count() < min_rows:
        return []
    # few numbers a row: stored once, for the passes of all fits
    rows = cut_lineage(valid.select(F.col(prob_col).alias("p"), F.col(label_idx).alias("y")))

    def fit(k: int):
        d = rows.select(array_to_vector(F.array(F.element_at("p", k + 1))).alias("features"), (F.col("y") == k).cast("double").alias("y"))
        return (IsotonicRegression(featuresCol="features", labelCol="y") if method == "isotonic" else
                LogisticRegression(featuresCol="features", labelCol="y", maxIter=50)).fit(d)

    with ThreadPoolExecutor(max_workers=4) as ex:
        return list(ex.map(fit, range(len(labels))))


def apply_calibration(df: DataFrame, models: list, prob_col: str = "probability_arr") -> DataFrame:
    if not models:
        return df
    out = df
    for k, m in enumerate(models):
        out = out.withColumn("_cf", array_to_vector(F.array(F.element_at(F.col(prob_col), k + 1))))
        if isinstance(m, LogisticRegressionModel):
            m = m.copy().setFeaturesCol("_cf").setProbabilityCol("_cp").setPredictionCol("_cy").setRawPredictionCol("_cr")
            out = m.transform(out).withColumn(f"_c{k}", F.get(vector_to_array("_cp"), 1)).drop("_cf", "_cp", "_cy", "_cr")
        else:
            out = m.setFeaturesCol("_cf").setPredictionCol(f"_c{k}").transform(out).drop("_cf")
    arr = F.array(*[F.col(f"_c{k}") for k in range(len(models))])
    s = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    norm = F.when(s > 0, F.transform(arr, lambda x: x / s)).otherwise(F.col(prob_col))
    return out.withColumn(prob_col, norm).drop(*[f"_c{k}" for k in range(len(models))])


def fold_ids(train: DataFrame, k: int, repeat: int, seed: int, key: str = "row_key", label: str = "label"
             ) -> DataFrame:
    """Stratified fold id per repeat: position inside the class in hash(seed, repeat) order mod k."""
    h = O.hash_order(seed * 1000 + repeat, F.col(key))
    n = O.with_row_number(train.withColumn("_fh", h), ["_fh", key], "_fp", partition_cols=[label])
    return n.withColumn("fold", ((F.col("_fp") - 1) % k).cast("int")).drop("_fh", "_fp")


CV_SCHEMA = "repeat int, fold int, accuracy double, f1_weighted double, status string"


def cross_validate(train: DataFrame, params: dict, folds: int, repeats: int, seed: int,
                   key: str = "row_key", parallelism: int = 4, fallback: tuple[float, float] | None = None) -> DataFrame:
    """Repeated stratified k-fold: accuracy and weighted F1 per fit (unweighted fits, as in the
    reference), then mean and population std.  Fits run concurrently from a thread pool over one
    materialized fold frame.  With fewer than two folds there is one row with status ``skipped``
    and the ``fallback`` (training accuracy, validation F1)."""
    spark = train.sparkSession
    if folds < 2:
        acc, f1 = fallback or (None, None)
        return spark.createDataFrame([(0, 0, acc, f1, "skipped")], CV_SCHEMA)
    wide = train.select(key, "label", "label_idx", "features")
    for r in range(repeats):
        wide = fold_ids(wide, folds, r, seed, key).withColumnRenamed("fold", f"fold{r}")
    wide = cut_lineage(wide)
    tasks = [(r, f) for r in range(repeats) for f in range(folds)]

    def run(t):
        r, f = t
        m = train_forest(wide.where(F.col(f"fold{r}") != f), params, weight_col=None)
        pred = m.transform(wide.where(F.col(f"fold{r}") == f))
        met = E.classification_metrics(pred.select(F.col("label_idx").cast("string").alias("y"),
                                                   F.col("prediction").cast("string").alias("yhat")), "y", "yhat")
        row = met.first()
        return (r, f, float(row["accuracy"]), float(row["f1_weighted"]), "fitted")

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        rows = list(ex.map(run, tasks))
    return spark.createDataFrame(rows, CV_SCHEMA)


def cv_summary(scores: DataFrame) -> DataFrame:
    """Means and population stds over the fits; a skipped validation has std 0 and no fits."""
    return scores.agg(F.avg("accuracy").alias("cv_mean_accuracy"), F.stddev_pop("accuracy").alias("cv_std_accuracy"),
                      F.avg("f1_weighted").alias("cv_mean_f1_weighted"),
                      F.stddev_pop("f1_weighted").alias("cv_std_f1_weighted"),
                      F.count_if(F.col("status") == "fitted").alias("n_fits"), F.max("status").alias("status"))


def batch_score(rows: DataFrame, feature_model, forest, labels: list[str]) -> DataFrame:
    """Score rows with one fitted (encoder, forest) pair: label, confidence, top-3."""
    x = FE.assemble_features(feature_model, rows)
    if isinstance(forest, ForestEnsemble):
        p = forest.probability(x)
    else:
        p = forest.transform(x).withColumn("probability_arr", vector_to_array("probability"))
    return with_prediction(p, labels)


def score_to_log(scored: DataFrame, model_version: Column, clinic: Column, created_at: Column) -> DataFrame:
    """Scoring output as prediction-log rows; a missing pet id becomes the zero UUID and a
    missing confidence 0."""
    zero = "00000000-0000-0000-0000-000000000000"
    feats = [c for c in ("animal_type", "gender", "age_months", "weight_kg", "temperature", "heart_rate",
                         "current_season", "vaccination_status", "medical_history", "symptom_duration",
                         "symptoms_list") if c in scored.columns]
    pet = F.col("pet_id") if "pet_id" in scored.columns else F.lit(None).cast("string")
    # the source row's id keeps equal inputs of two visits apart
    source = [F.col("id").cast("string").alias("_id")] if "id" in scored.columns else []
    return scored.select(
        F.sha2(F.to_json(F.struct(*feats, *source, model_version.alias("_v"))), 256).alias("id"),
        F.lit(None).cast("string").alias("visit_id"), F.coalesce(pet, F.lit(zero)).alias("pet_id"),
        F.to_json(F.struct(*feats)).alias("prediction_input"),
        F.to_json(F.struct(F.col("predicted_label").alias("diagnosis"), F.col("confidence"),
                           F.col("top_k"))).alias("prediction_output"),
        model_version.alias("model_version"), F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence_score"),
        F.to_json(F.col("top_k")).alias("top_k_predictions"), F.lit(None).cast("string").alias("veterinarian_id"),
        clinic.alias("clinic_id"), created_at.alias("created_at"))
