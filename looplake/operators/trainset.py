"""Training-set construction for every scope in one pass.

Rows carry ``scope_key`` end to end: thresholds, core-memory sizes and missing
classes are per-scope aggregates joined back, never per-scope driver loops.
Sampling is hash-order sampling (``sha256(seed ':' key)``), deterministic and
independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from looplake.config import DEFAULT, FEATURES, LABEL, Config
from looplake.functions import scalars as S
from looplake.operators import ordering as O
from looplake.operators.scope import dedup_predictions_by_text_id, feature_columns, parse_features
from looplake.session import cut_lineage

FRAME_COLUMNS = ("scope_key", "source", "row_key", *FEATURES, "label", "weight", "sample_ts")
CORE_TS = "1970-01-01 00:00:00"
COMPLETION_TS = "1970-01-02 00:00:00"


def _with_scope(df: DataFrame) -> DataFrame:
    return df if "scope_key" in df.columns else df.withColumn("scope_key", F.lit("global:GLOBAL"))


def match_feedback(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Feedback joined to its prediction on the text id (first prediction per id wins),
    with the 11 features parsed from the prediction input."""
    p = dedup_predictions_by_text_id(predictions, ["prediction_input", "created_at"]).select(
        "_tid", F.col("created_at").alias("_pts"), F.col("prediction_input").alias("_json"))
    f = feedback.where(F.col("prediction_id").isNotNull())
    # only the matched inputs are parsed, each once
    m = parse_features(f.join(p, f["prediction_id"].cast("string") == p["_tid"], "inner"), "_json")
    return m.select(*[f[c] for c in f.columns], "_pts", *feature_columns())


def explode_feedback_signals(matched: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Accept -> (final, positive weight).  Reject with ai == final -> (final, negative).
    Other reject -> (final, positive) plus (ai, negative) when ai is non-blank."""
    m = _with_scope(matched)
    pos, neg = S.feedback_weights("data_quality_score", "confidence_rating", cfg)
    correct = F.coalesce(F.col("is_correct"), F.lit(False))
    final, ai = F.col("final_diagnosis"), F.col("ai_diagnosis")
    same = ai.isNotNull() & (final == ai)
    ai_ok = ai.isNotNull() & (S.strip(ai) != "")

    def sig(label: Column, weight: Column, role: str, cond: Column) -> Column:
        return F.when(cond, F.struct(label.alias("label"), weight.alias("weight"), F.lit(role).alias("role")))

    sigs = F.array(
        sig(final, pos, "pos", correct | ~same),
        sig(final, neg, "neg", ~correct & same),
        sig(ai, neg, "neg", ~correct & ~same & ai_ok),
    )
    ts = S.feedback_timestamp(F.col("created_at") if "created_at" in m.columns else F.col("timestamp"), F.col("_pts"))
    return (m.select("scope_key", "id", *FEATURES, ts.alias("sample_ts"),
                     F.explode(F.filter(sigs, lambda x: x.isNotNull())).alias("s"))
            .select("scope_key", F.lit("feedback").alias("source"),
                    F.concat(F.lit("f:"), F.col("id").cast("string"), F.lit(":"), F.col("s.role")).alias("row_key"),
                    *FEATURES, F.col("s.label").alias("label"), F.col("s.weight").alias("weight"), "sample_ts"))


def quality_threshold(df: DataFrame, col: str = "weight", cfg: Config = DEFAULT, by: list | None = None
                      ) -> DataFrame:
    """max(min_threshold, linear-interpolated percentile) per group; fallback for an empty input."""
    q = cfg.quality_percentile / 100.0
    by = list(by or [])
    agg = df.groupBy(*by).agg(F.percentile(F.col(col).cast("double"), F.lit(q)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    return agg.select(*by, F.when(F.col("_n") == 0, F.lit(cfg.quality_fallback_threshold))
                      .otherwise(F.greatest(F.lit(cfg.quality_min_threshold), F.col("_p"))).alias("threshold"))


def quality_filter(df: DataFrame, thresholds: DataFrame, col: str = "weight", by: list | None = None) -> DataFrame:
    by = list(by or [])
    t = F.broadcast(thresholds) if not by else thresholds  # one row when unkeyed
    j = df.join(t, by, "inner") if by else df.crossJoin(t)
    return j.where(F.col(col) >= F.col("threshold")).drop("threshold")


def core_memory_count(n: Column, cfg: Config = DEFAULT) -> Column:
    r = cfg.core_memory_ratio
    raw = F.bround(n.cast("double") * r / max(1e-9, 1.0 - r), 0).cast("bigint")
    return F.greatest(F.lit(0), F.least(raw, F.lit(cfg.core_memory_max_rows)))


def hash_ranked(df: DataFrame, n: int, seed: int, key: str, out: str = "pos") -> DataFrame:
    """The first ``n`` rows in hash order with their 1-based position (bounded: at most n rows)."""
    top = df.withColumn("_h", O.hash_order(seed, F.col(key))).orderBy("_h", key).limit(int(n))
    return top.withColumn(out, F.row_number().over(Window.orderBy("_h", key))).drop("_h")


def baseline_rows(baseline: DataFrame, source: str, prefix: str, weight: float, ts: str) -> list[Column]:
    feats = []
    for f in FEATURES:
        c = F.col(f)
        if f == "medical_history" and source == "completion":
            c = F.coalesce(c, F.lit("Unknown"))
        if f == "symptoms_list" and source == "completion":
            c = F.coalesce(c, F.lit(""))
        feats.append(c.alias(f))
    return [F.lit(source).alias("source"), F.concat(F.lit(prefix), F.col("row_id").cast("string")).alias("row_key"),
            *feats, F.col(LABEL).cast("string").alias("label"), F.lit(weight).alias("weight"),
            F.lit(ts).cast("timestamp").alias("sample_ts")]


def mix_core_memory(frame: DataFrame, baseline: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Append ``core_n = bround(n·r/(1−r))`` (capped) hash-sampled baseline rows per scope."""
    if not (0.0 < cfg.core_memory_ratio < 1.0) or cfg.core_memory_max_rows <= 0:
        return frame
    n = frame.groupBy("scope_key").agg(core_memory_count(F.count(F.lit(1)), cfg).alias("_core_n"))
    # at most core_memory_max_rows rows, kept: every reader of the frame would rank the whole baseline again
    cand = cut_lineage(hash_ranked(baseline, cfg.core_memory_max_rows, cfg.seed, "row_id"))
    # an equi-join on the position; the candidates are bounded by core_memory_max_rows
    wanted = n.where("_core_n > 0").select("scope_key", F.explode(F.sequence(F.lit(1), F.col("_core_n").cast("int"))).alias("pos"))
    core = (wanted.join(F.broadcast(cand), "pos")
            .select("scope_key", *baseline_rows(baseline, "core", "c:", cfg.core_memory_quality_score, CORE_TS)))
    return frame.unionByName(core)


def per_class_pick(df: DataFrame, label_col: str, k: int, seed: int, key: str) -> DataFrame:
    """Up to ``k`` rows per label in hash order (``row_number <= k`` becomes a per-partition
    window group limit before the shuffle, so a hot label costs k rows per partition)."""
    w = Window.partitionBy(label_col).orderBy("_h", key)
    return (df.withColumn("_h", O.hash_order(seed, F.col(key))).withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= k).drop("_h", "_r"))


def label_difference(baseline_labels: DataFrame, frame_labels: DataFrame, label: str = "label", by: list | None = None) -> DataFrame:
    """Baseline labels absent from the frame (sorted), or from every group ``by`` of the frame."""
    if by:
        # one row with the model's classes, and one row a group with the classes it has
        labels = baseline_labels.agg(F.collect_set(F.col(label).cast("string")).alias("_all"))
        have = frame_labels.groupBy(*by).agg(F.collect_set(F.col(label).cast("string")).alias("_have"))
        return have.crossJoin(F.broadcast(labels)).select(*by, F.explode(F.array_except("_all", "_have")).alias(label))
    return baseline_labels.select(F.col(label).cast("string").alias(label)).distinct().subtract(
        frame_labels.select(F.col(label).cast("string").alias(label))).orderBy(label)


def complete_classes(frame: DataFrame, baseline: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per scope, add ``k`` reference rows for each baseline label missing after the core mix."""
    if cfg.completion_per_missing_class <= 0:
        return frame
    # a few rows of every class, kept: every reader of the frame would pick from the whole baseline again
    picks = cut_lineage(per_class_pick(baseline.withColumn("label", F.col(LABEL).cast("string")), "label",
                                       cfg.completion_per_missing_class, cfg.seed, "row_id"))
    # one row with the model's classes (each has a pick), and one row a scope with the classes it has
    labels = picks.agg(F.collect_set("label").alias("_all"))
    present = frame.groupBy("scope_key").agg(F.collect_set("label").alias("_have"))
    missing = present.crossJoin(F.broadcast(labels)).select(
        "scope_key", F.explode(F.array_except("_all", "_have")).alias("label"))
    add = missing.join(picks, "label").select(
        "scope_key", *baseline_rows(picks, "completion", "m:", cfg.completion_quality_score, COMPLETION_TS))
    return frame.unionByName(add)


def fill_missing_timestamps(frame: DataFrame, as_of, order_col: str = "row_key") -> DataFrame:
    """Null sample times -> midnight(as_of) + i seconds, i = order among the nulls of the scope."""
    base = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    nulls = frame.where(F.col("sample_ts").isNull())
    numbered = O.with_row_number(nulls, [order_col], "_i", partition_cols=["scope_key"])
    filled = numbered.withColumn("sample_ts", base + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.col("_i") - 1).cast("decimal(18,6)"))).drop("_i")
    return frame.where(F.col("sample_ts").isNotNull()).unionByName(filled)


def collect_training_frame(feedback: DataFrame, predictions: DataFrame, baseline: DataFrame | None, as_of,
                           cfg: Config = DEFAULT, fill_timestamps: bool = True) -> DataFrame:
    """Feedback signals -> weighted-score threshold -> core-memory mix -> class completion -> filled times.

    ``feedback`` is already scoped (``scope_key``) and filtered (eligible/window/batch).  The
    signals (the feedback ⋈ prediction join, the expensive part) are materialized once in the
    shared checkpoint folder; thresholds, core-memory sizes and missing classes all read them.
    """
    sig = cut_lineage(explode_feedback_signals(match_feedback(_with_scope(feedback), predictions), cfg))
    thr = quality_threshold(sig, "weight", cfg, by=["scope_key"])
    kept = quality_filter(sig, thr, "weight", by=["scope_key"])
    frame = kept
    if baseline is not None:
        frame = mix_core_memory(frame, baseline, cfg)
        frame = complete_classes(frame, baseline, cfg)
    frame = frame.select(*FRAME_COLUMNS)
    # only feedback rows can lack a time (core/completion rows carry fixed ones)
    if fill_timestamps and not sig.where(F.col("sample_ts").isNull()).isEmpty():
        frame = fill_missing_timestamps(frame, as_of)
    return frame


def feedback_only_frame(feedback: DataFrame, predictions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Feedback rows with features and the raw quality score, above the per-scope threshold."""
    m = match_feedback(_with_scope(feedback), predictions).select(
        "scope_key", "id", *FEATURES, F.col("final_diagnosis").alias("label"),
        F.coalesce(F.col("data_quality_score").cast("double"), F.lit(1.0)).alias("quality"))
    thr = quality_threshold(m, "quality", cfg, by=["scope_key"])
    return quality_filter(m, thr, "quality", by=["scope_key"])


# ------------------------------------------------------------------ class statistics
def class_distribution(frame: DataFrame, label: str = "label", by: list | None = None, min_classes: int = 2
                       ) -> DataFrame:
    by = list(by or [])
    c = frame.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return c.withColumn("n_classes", F.count(F.lit(1)).over(w)).withColumn(
        "diversity_ok", F.col("n_classes") >= min_classes)


def balanced_class_weights(labels: DataFrame, label: str = LABEL) -> DataFrame:
    """sklearn 'balanced': n / (k · count_c) over the reference labels."""
    c = labels.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("_c"))
    tot = c.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(F.broadcast(tot)).select("label", (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("class_weight"))


def apply_class_weights(train: DataFrame, weights: DataFrame) -> DataFrame:
    """weight × class weight (default 1.0); the weight table has one row per class."""
    return (train.join(F.broadcast(weights), "label", "left")
            .withColumn("weight", F.col("weight") * F.coalesce(F.col("class_weight"), F.lit(1.0)))
            .drop("class_weight"))


def majority_class(frame: DataFrame, label: str = "label", by: list | None = None) -> DataFrame:
    """Most frequent label; ties go to the smallest label."""
    by = list(by or [])
    return frame.groupBy(*by).agg(F.mode(F.col(label), True).alias("majority_label"))


def small_sample_notes(frame: DataFrame, cfg: Config = DEFAULT, by: list | None = None) -> DataFrame:
    """Accept-only and small-sample notes per scope (frame must carry ``is_correct``)."""
    by = list(by or [])
    a = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.bool_or(F.col("is_correct") == F.lit(False)).alias("_has_reject"))
    accept_only = ~F.coalesce(F.col("_has_reject"), F.lit(False))
    small = F.col("n") < cfg.reliable_metrics_min_samples
    note = F.concat_ws(" ", F.when(small, F.lit(
        f"small sample: fewer than {cfg.reliable_metrics_min_samples} rows; metrics are not reliable.")),
        F.when(accept_only, F.lit("accept-only feedback: no reject rows in this batch.")))
    return a.select(*by, "n", accept_only.alias("accept_only"), small.alias("small_sample_warning"),
                    F.when(note == "", F.lit(None)).otherwise(note).alias("metrics_note"))


# ------------------------------------------------------------------ splits
#: Hex digits of the hash by which rows are counted before any is ranked: 65,536 counts a group at most.
SPLIT_DIGITS = 4


def random_split(frame: DataFrame, ratio: Column | float, seed: int, key: str = "row_key", label: str = "label",
                 by: list | None = None) -> DataFrame:
    """Validation flag: per class (stratified when every class has >= 2 rows and there are >= 2
    classes) the first ``bround(count·ratio)`` rows in hash order; otherwise the same rule over
    all rows.

    Selected by a cut-off of the hash: rows are counted by (group, hash prefix), running counts give the
    prefix that holds a group's last validation row, and only the rows of that prefix are ranked.  Every row
    is then compared with its group's cut-off, so no table is sorted, numbered or checkpointed.  Rows that
    repeat a key stay on one side; a label may be null.  ``ratio`` is the same for all rows of a group."""
    by = list(by or [])
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    rows = frame.withColumn("_r", r.cast("double")).withColumn("_h", O.hash_order(seed, F.col(key))) \
        .withColumn("_p", F.substring("_h", 1, SPLIT_DIGITS))
    # read four times below
    counts = cut_lineage(rows.groupBy(*by, label, "_p").agg(F.count(F.lit(1)).alias("_c"), F.first("_r").alias("_r")))
    cls = counts.groupBy(*by, label).agg(F.sum("_c").alias("_cn"), F.first("_r").alias("_r"))
    stat = cls.groupBy(*by).agg(((F.min("_cn") >= 2) & (F.count(F.lit(1)) >= 2)).alias("stratified"),
                                F.sum("_cn").alias("_n"), F.first("_r").alias("_r"))
    # the group in which a row is ranked is its class or, unstratified, everything
    group = F.when(F.col("stratified"), F.col(label))
    sized = (counts.drop("_r").join(stat.drop("_n", "_r"), by) if by else counts.drop("_r").crossJoin(F.broadcast(stat.drop("_n", "_r")))) \
        .groupBy(*by, group.alias("_g"), "_p").agg(F.sum("_c").alias("_c"))
    both = cls.join(stat.select(*by, "stratified"), by) if by else cls.crossJoin(F.broadcast(stat.select("stratified")))
    quota = both.groupBy(*by, group.alias("_g")).agg(F.bround(F.sum("_cn") * F.first("_r"), 0).cast("long").alias("_quota"))
    w = Window.partitionBy(*by, "_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    run = sized.withColumn("_upto", F.sum("_c").over(w)).alias("x")
    same = _same_group(by)
    at = (run.join(quota.alias("y"), same("x", "y"))
          .where((F.col("_upto") - F.col("_c") < F.col("_quota")) & (F.col("_upto") >= F.col("_quota")))
          .select(*[F.col(f"x.{c}").alias(c) for c in (*by, "_g", "_p")], (F.col("_quota") - F.col("_upto") + F.col("_c")).alias("_left")))
    flagged = rows.join(stat.select(*by, "stratified"), by) if by else rows.crossJoin(F.broadcast(stat.select("stratified")))
    flagged = flagged.withColumn("_g", group)
    place = Window.partitionBy(*[f"x.{c}" for c in (*by, "_g")]).orderBy("x._h", f"x.{key}")
    last = (flagged.select(*by, "_g", "_p", "_h", key).alias("x")
            .join(at.alias("y"), same("x", "y") & (F.col("x._p") == F.col("y._p")))
            .withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") == F.col("_left"))
            .select(*[F.col(f"x.{c}").alias(c) for c in (*by, "_g")], F.struct(F.col("x._h"), F.col(f"x.{key}")).alias("_last")))
    out = flagged.alias("x").join(last.alias("y"), same("x", "y"), "left")
    here = F.struct(F.col("x._h"), F.col(f"x.{key}"))
    return out.select(*[F.col(f"x.{c}").alias(c) for c in (*frame.columns, "stratified")],
                      F.coalesce(here <= F.col("_last"), F.lit(False)).alias("is_validation"))


def _same_group(by: list):
    """Join condition on the split's group; null scopes and classes are groups of their own."""
    def cond(a: str, b: str) -> Column:
        c = F.col(f"{a}._g").eqNullSafe(F.col(f"{b}._g"))
        for k in by:
            c = c & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return c
    return cond


def time_aware_split(frame: DataFrame, ratio: float, cfg: Config = DEFAULT, ts: str = "sample_ts",
                     key: str = "row_key", label: str = "label", by: list | None = None) -> DataFrame:
    """Per group the last ``max(1, min(n−1, bround(n·ratio)))`` rows by (ts, key) are validation, valid
    only when n >= min samples and the validation part has >= 2 classes (when the data has >= 2)."""
    by = list(by or [])
    numbered = O.with_row_number(frame, [ts, key], "_pos", partition_cols=by)
    n = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("_k"))
    n_test = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.bround(F.col("_n") * ratio, 0).cast("bigint")))
    j = numbered.join(n, by) if by else numbered.crossJoin(F.broadcast(n))
    j = j.withColumn("is_validation", F.col("_pos") > F.col("_n") - n_test)
    kv = j.where("is_validation").groupBy(*by).agg(F.count_distinct(label).alias("_kv"))
    j = j.join(kv, by, "left") if by else j.crossJoin(F.broadcast(kv))
    ok = (F.col("_n") >= cfg.time_aware_min_samples) & (F.col("_n") - n_test >= 1) & (
        (F.col("_k") < 2) | (F.coalesce("_kv", F.lit(0)) >= 2))
    return j.withColumn("time_split_ok", ok).drop("_pos", "_n", "_k", "_kv")


# ------------------------------------------------------------------ seeds and adaptive parameters
def split_seed(feedback: DataFrame, by: list, base_seed: int = 42, training_id_col: str | None = None) -> DataFrame:
    """Per group (a batch): sha256(base ‖ training id or 'no-training-id' ‖ Σ(pid ‖ lower(strip(final)) ‖ '|'))
    over rows in (created_at, id) order -> first 4 bytes & 0x7FFFFFFF.  Groups are bounded batches."""
    piece = F.concat(F.coalesce(F.col("prediction_id").cast("string"), F.lit("")),
                     F.lower(S.strip(F.coalesce(F.col("final_diagnosis"), F.lit("")))), F.lit("|"))
    tid = F.coalesce(F.col(training_id_col).cast("string"), F.lit("no-training-id")) if training_id_col \
        else F.lit("no-training-id")
    g = feedback.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col("created_at"), F.col("id"), piece.alias("p")))).alias("_rows"),
        F.first(tid).alias("_tid"))
    text = F.concat(F.lit(str(base_seed)), F.col("_tid"), F.array_join(F.transform("_rows", lambda r: r["p"]), ""))
    return g.select(*by, S.seed_from_text(text).alias("split_seed"))


def adaptive_forest_params(n: Column, n_features: Column, cfg: Config = DEFAULT) -> list[Column]:
    """Tiered forest parameters as columns (n = rows of the training split)."""
    nf = F.least(n_features, F.lit(cfg.max_feature_count))
    small, medium, large = cfg.tier_small, cfg.tier_medium, cfg.tier_large
    trees = (F.when(n < small, cfg.n_estimators_small).when(n < medium, cfg.n_estimators_medium)
             .when(n < large, cfg.n_estimators_large).otherwise(cfg.n_estimators_xlarge))
    depth = F.least(F.when(n < small, cfg.max_depth_small).when(n < medium, cfg.max_depth_medium)
                    .otherwise(cfg.max_depth_large), nf)
    split = (F.when(n < small, cfg.min_split_small).when(n < medium, cfg.min_split_medium)
             .otherwise(F.greatest(F.lit(cfg.min_split_large), F.floor(n * 0.02).cast("int"))))
    leaf = (F.when(n < small, cfg.min_leaf_small).when(n < medium, cfg.min_leaf_medium)
            .otherwise(F.greatest(F.lit(cfg.min_leaf_large), F.floor(n * 0.01).cast("int"))))
    return [trees.cast("int").alias("n_estimators"), depth.cast("int").alias("max_depth"),
            split.cast("int").alias("min_samples_split"), leaf.cast("int").alias("min_samples_leaf"),
            (n >= small).alias("bootstrap"), F.lit(cfg.seed).alias("random_state")]


def adaptive_cv_folds(min_class_count: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(min_class_count < 2, F.lit(1)).otherwise(
        F.greatest(F.lit(2), F.least(F.lit(cfg.cv_max_folds), min_class_count))).cast("int")


def column_profile(df: DataFrame, columns: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Per column: null ratio, distinct count and kind, from one aggregation + unpivot."""
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.count_distinct(F.col(c)).alias(f"{c}__nd")]
    row = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    parts = []
    for c in columns:
        is_text = dtypes[c] == "string"
        ratio = F.col(f"{c}__nulls") / F.col("_n")
        nd = F.col(f"{c}__nd")
        kind = (F.when(ratio > cfg.missing_value_threshold, F.lit("skipped"))
                .when(F.lit(is_text), F.lit("categorical"))
                .when(nd <= F.least(F.lit(float(cfg.max_unique_for_categorical)),
                                    F.col("_n") * cfg.unique_ratio_threshold), F.lit("categorical"))
                .otherwise(F.lit("numeric")))
        parts.append(F.struct(F.lit(c).alias("column"), ratio.alias("null_ratio"), nd.alias("distinct_count"),
                              kind.alias("kind")))
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
