"""Feature encoding: relational long-form encoders (checkable in SQL) and the Spark ML
pipeline that produces the sparse feature vector (numeric ‖ one-hot ‖ symptom multi-hot)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from looplake.config import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from looplake.functions import scalars as S


def scale_numeric(frame: DataFrame, columns=NUMERIC_FEATURES, by: list | None = None, key: str = "row_key"
                  ) -> DataFrame:
    """Standard scaling with the population std (zero variance -> scale 1), long form."""
    by = list(by or [])
    stats = frame.groupBy(*by).agg(*[F.avg(c).alias(f"{c}__m") for c in columns],
                                   *[F.stddev_pop(c).alias(f"{c}__s") for c in columns])
    j = frame.join(stats, by, "inner") if by else frame.crossJoin(F.broadcast(stats))
    parts = []
    for c in columns:
        sd = F.col(f"{c}__s")
        scale = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        parts.append(F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"{c}__m")) / scale).alias("scaled")))
    return j.select(*by, key, F.explode(F.array(*parts)).alias("p")).select(*by, key, "p.feature", "p.scaled")


def category_slots(frame: DataFrame, columns=CATEGORICAL_FEATURES, by: list | None = None) -> DataFrame:
    """Fitted one-hot layout: (feature, category, slot) with categories in sorted order."""
    by = list(by or [])
    long = frame.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string")
                                                          .alias("category")) for c in columns])).alias("p"))
    d = long.select(*by, "p.feature", "p.category").where(F.col("category").isNotNull()).distinct()
    w = Window.partitionBy(*by, "feature").orderBy("category")
    return d.withColumn("slot", (F.row_number().over(w) - 1).cast("int"))


def one_hot_long(rows: DataFrame, slots: DataFrame, columns=CATEGORICAL_FEATURES, by: list | None = None,
                 key: str = "row_key") -> DataFrame:
    """(row, feature, slot) for each known category; unknown categories produce no slot (all zeros)."""
    by = list(by or [])
    long = rows.select(*by, key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string")
                                                              .alias("category")) for c in columns])).alias("p"))
    long = long.select(*by, key, "p.feature", "p.category")
    return long.join(slots, by + ["feature", "category"], "inner").select(*by, key, "feature", "slot")


def symptom_vocabulary(frame: DataFrame, col: str = "symptoms_list", by: list | None = None) -> DataFrame:
    """Sorted unique symptom tokens with their index."""
    by = list(by or [])
    toks = frame.select(*by, F.explode(S.parse_symptoms(col)).alias("token")).distinct()
    w = Window.partitionBy(*by).orderBy("token") if by else Window.orderBy("token")
    return toks.withColumn("token_index", (F.row_number().over(w) - 1).cast("int"))


def multi_hot_long(rows: DataFrame, vocab: DataFrame, col: str = "symptoms_list", by: list | None = None,
                   key: str = "row_key") -> DataFrame:
    """Binary multi-hot in long form; unknown tokens are ignored."""
    by = list(by or [])
    t = rows.select(*by, key, F.explode(F.array_distinct(S.parse_symptoms(col))).alias("token"))
    return t.join(vocab, by + ["token"], "inner").select(*by, key, "token_index")


def numeric_scaler(train: DataFrame, numeric=NUMERIC_FEATURES) -> SQLTransformer:
    """Standard scaling of the numeric columns by the training rows' mean and population std (zero
    variance -> scale 1) as a stage with fixed numbers; the statistics are one aggregated row."""
    s = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
    cols = [f"(CAST({c} AS DOUBLE) - {s[f'm{i}'] or 0.0!r}D) / {s[f's{i}'] or 1.0!r}D AS {c}__scaled"
            for i, c in enumerate(numeric)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(cols)} FROM __THIS__")


def feature_pipeline(vocabulary: list[str], scaler: SQLTransformer, numeric=NUMERIC_FEATURES,
                     categorical=CATEGORICAL_FEATURES, label: str | None = "label") -> Pipeline:
    """[scaled numeric ‖ one-hot (sorted categories, unknown -> zeros) ‖ symptom multi-hot] as one
    sparse vector.  Fitted once per training run and reused ("locked encoders").  The label index
    has the training labels only; rows without a label column are scored without it."""
    stages = [scaler]
    idx_cols = [f"{c}__idx" for c in categorical]
    stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx_cols, handleInvalid="keep",
                                stringOrderType="alphabetAsc"))
    oh_cols = [f"{c}__oh" for c in categorical]
    # the indexer's extra "unknown" index is the last category: dropping it encodes an unseen
    # (or missing) category as all zeros, as the reference's encoder does
    stages.append(OneHotEncoder(inputCols=idx_cols, outputCols=oh_cols, dropLast=True, handleInvalid="error"))
    stages.append(CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_symptom_tokens",
                                                       outputCol="_symptoms_vec", binary=True))
    stages.append(VectorAssembler(inputCols=[f"{c}__scaled" for c in numeric] + oh_cols + ["_symptoms_vec"], outputCol="features",
                                  handleInvalid="keep"))
    if label:
        stages.append(StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc",
                                    handleInvalid="error"))
    return Pipeline(stages=stages)


def with_tokens(df: DataFrame, col: str = "symptoms_list") -> DataFrame:
    return df.withColumn("_symptom_tokens", S.parse_symptoms(col))


def fit_features(train: DataFrame, label: str = "label") -> PipelineModel:
    """Fit the encoders on the training rows.  The vocabulary (distinct symptom tokens) and the
    scaler's one row, both model state, are all that is brought to the driver."""
    vocab = [r["token"] for r in symptom_vocabulary(train).orderBy("token").select("token").collect()]
    pipe = feature_pipeline(vocab, numeric_scaler(train), label=label)
    return pipe.fit(with_tokens(train))


def assemble_features(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(with_tokens(rows))
