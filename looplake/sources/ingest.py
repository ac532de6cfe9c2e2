"""Sources and sinks: JSON/CSV readers with explicit schemas, bootstrap CSV ingest and
validation, the input contract, legacy-id widening, dataset exports and stage tables.

All readers take explicit schemas (nothing is inferred).  Files written by these
functions go under the cluster's shared checkpoint folder unless a path is given.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby, islice
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looplake.config import DEFAULT, FEATURES, LABEL, Config
from looplake.functions import scalars as S
from looplake.operators import ordering as O
from looplake.session import ensure_checkpoint_dir

# ------------------------------------------------------------------ schemas (ids are strings)
PREDICTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("visit_id", T.StringType()),
    T.StructField("pet_id", T.StringType()), T.StructField("prediction_input", T.StringType()),
    T.StructField("prediction_output", T.StringType()), T.StructField("model_version", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()), T.StructField("top_k_predictions", T.StringType()),
    T.StructField("veterinarian_id", T.StringType()), T.StructField("clinic_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
FEEDBACK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("prediction_id", T.StringType()),
    T.StructField("final_diagnosis", T.StringType()), T.StructField("is_correct", T.BooleanType()),
    T.StructField("ai_diagnosis", T.StringType()), T.StructField("confidence_rating", T.IntegerType()),
    T.StructField("is_training_eligible", T.BooleanType()), T.StructField("data_quality_score", T.DoubleType()),
    T.StructField("training_pool", T.StringType()), T.StructField("created_at", T.TimestampType()),
])
BASELINE_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("pet_id", T.StringType()),
    T.StructField("animal_type", T.StringType()), T.StructField("gender", T.StringType()),
    T.StructField("age_months", T.IntegerType()), T.StructField("weight_kg", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()), T.StructField("heart_rate", T.IntegerType()),
    T.StructField("current_season", T.StringType()), T.StructField("vaccination_status", T.StringType()),
    T.StructField("medical_history", T.StringType()), T.StructField("symptom_duration", T.IntegerType()),
    T.StructField("symptoms_list", T.StringType()), T.StructField(LABEL, T.StringType()),
])
# Columns a bootstrap CSV must carry.
BOOTSTRAP_REQUIRED = ("pet_id", "animal_type", "gender", "age_months", "weight_kg", "temperature", "heart_rate",
                      "current_season", "vaccination_status", "medical_history", "symptoms_list",
                      "symptom_duration", "target_diagnosis")
BOOTSTRAP_INT = ("age_months", "symptom_duration", "heart_rate")
BOOTSTRAP_FLOAT = ("weight_kg", "temperature")
BOOTSTRAP_TEXT = ("animal_type", "gender", "current_season", "vaccination_status")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/looplake-io/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ readers / writers
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON records parsed with an explicit schema; ``multi_line=True`` for files holding one
    JSON array each (the worker's file mode), JSON Lines otherwise."""
    return (spark.read.schema(schema).option("multiLine", multi_line).option("timestampFormat", TS_FORMAT)
            .json(path))


def write_json_records(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("timestampFormat", TS_FORMAT).json(path)
    return path


def read_baseline_csv(spark: SparkSession, path: str, label_only: bool = False,
                      label_col: str = LABEL) -> DataFrame:
    """Typed CSV scan with column projection (label only, or 11 features + label)."""
    df = spark.read.schema(BASELINE_SCHEMA).option("header", True).csv(path)
    return df.select(label_col) if label_only else df.select(*FEATURES, label_col)


def write_csv(df: DataFrame, path: str, partition_by: list | None = None) -> str:
    """CSV with a header; text is written verbatim (Spark's writer trims surrounding
    whitespace by default, which would alter values such as symptom lists)."""
    w = (df.write.mode("overwrite").option("header", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


#: A folder of a missing or empty value; characters that Spark escapes in folder names.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in (*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^"))}
#: Rows that a reading task hands on at a time.
EXPORT_BATCH = 8192


def _file_store(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path with its scheme, and whether tasks reach it through ``pyarrow.fs``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    try:
        pafs.FileSystem.from_uri(full)
    except (OSError, ValueError):
        return full, False
    return full, True


def dataset_export(snapshot: DataFrame, path: str, by: list | None = None) -> str:
    """Snapshot rows to CSV with a header, one folder per training id (or per ``by``) with one file: the
    rows of a folder are brought to one task first, else every task writes a file to nearly every folder.

    Rows become Spark's CSV text; tasks write the files of their folders through ``pyarrow.fs``, under a name of
    their attempt until a file is whole.  Spark's own writer costs some ten milliseconds and several file
    operations a folder, many of them one by one on the driver; it is used where ``pyarrow.fs`` knows no way."""
    by = by or ["training_id"]
    spark = snapshot.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = snapshot.repartition(n, *by)
    full, reached = _file_store(spark, path)
    if not reached:
        return write_csv(dealt, path, by)
    write_csv(spark.createDataFrame([], snapshot.schema), path, by)  # an empty folder, whatever was there
    store, root = pafs.FileSystem.from_uri(full)
    store.delete_file(done := f"{root}/_SUCCESS")
    columns = [c for c in snapshot.columns if c not in by]
    header = spark.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(f"c{k}") for k, c in enumerate(columns))))).first()[0]
    text = F.to_csv(F.struct(*columns), {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    lines = dealt.select(*(F.col(c).cast("string").alias(f"_{k}") for k, c in enumerate(by)), text.alias("_line")) \
        .sortWithinPartitions(*(f"_{k}" for k in range(len(by))))
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(full)
        task = TaskContext.get()
        name, files = f"part-{task.partitionId():05d}-{run}.csv", 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for values, its in groupby(rows, key=lambda r: r[:-1]):
            folder = "/".join([root, *(f"{c}={v.translate(_ESCAPED) if v else NO_VALUE}" for c, v in zip(by, values, strict=True))])
            store.create_dir(folder)
            with store.open_output_stream(draft := f"{folder}/.{name}.{task.taskAttemptId()}") as f:
                f.write(f"{header}\n".encode())
                while some := list(islice(its, EXPORT_BATCH)):
                    f.write("".join(f"{r[-1]}\n" for r in some).encode())
            store.move(draft, f"{folder}/{name}")
            files += 1
        yield pa.RecordBatch.from_pydict({"files": [files]})

    lines.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    store.open_output_stream(done).close()
    return path


def _folders(store: pafs.FileSystem, at: str) -> list[str]:
    found = store.get_file_info(pafs.FileSelector(at))
    return [x.path for x in found if x.type == pafs.FileType.Directory and not x.base_name.startswith(("_", "."))]


def _csv_records(text: str) -> Iterator[str]:
    """Records of CSV text; a line end inside quotes belongs to a value."""
    held = ""
    for line in text.split("\n"):
        held = f"{held}\n{line}" if held else line
        if '"' not in held or re.sub(r"\\.", "", held, flags=re.S).count('"') % 2 == 0:
            if held:
                yield held
            held = ""
    if held:
        yield held


def read_export(spark: SparkSession, path: str, schema: T.StructType, by: list) -> DataFrame:
    """The files of a ``dataset_export`` of rows of this schema: every value as text, the folders' values in their
    types.  Folders are listed and files read in tasks of many folders, not a task or a split for some files each."""
    columns = [f.name for f in schema.fields if f.name not in by]
    kinds = {f.name: f.dataType for f in schema.fields}
    texts = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    full, reached = _file_store(spark, path)
    if not reached:
        return spark.read.schema(T.StructType([*texts.fields, *(T.StructField(c, kinds[c]) for c in by)])).option("header", True).csv(path)
    store, root = pafs.FileSystem.from_uri(full)
    deeper = len(by) - 1

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(full)
        for b in batches:
            found = b["folder"].to_pylist()
            for _ in range(deeper):
                found = [x for folder in found for x in _folders(store, folder)]
            for k in range(0, len(found), EXPORT_BATCH):
                yield pa.RecordBatch.from_pydict({"folder": found[k:k + EXPORT_BATCH]}, schema=pa.schema([("folder", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(full)

        def rows():
            for folder in (x for b in batches for x in b["folder"].to_pylist()):
                values = [unquote(x.partition("=")[2]) for x in folder.split("/")[-len(by):]]
                values = [None if v == NO_VALUE else v for v in values]
                for x in store.get_file_info(pafs.FileSelector(folder)):
                    if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")):
                        with store.open_input_stream(x.path) as f:
                            yield from ((*values, line) for line in islice(_csv_records(f.read().decode()), 1, None))

        its = rows()
        while some := list(islice(its, EXPORT_BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], names=[*(f"_{k}" for k in range(len(by))), "_line"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    top = spark.createDataFrame([(x,) for x in _folders(store, root)], "folder string")
    if deeper:
        top = top.repartition(n, "folder").mapInArrow(listed, "folder string")
    lines = top.repartition(n, "folder").mapInArrow(read, ", ".join([*(f"_{k} string" for k in range(len(by))), "_line string"]))
    parsed = lines.withColumn("_row", F.from_csv("_line", F.lit(texts.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", "))))
    return parsed.select("_row.*", *(F.col(f"_{k}").cast(kinds[c]).alias(c) for k, c in enumerate(by)))


def dataset_summary(snapshot: DataFrame, by: list | None = None) -> DataFrame:
    """Row count and the column list of a snapshot (per training id when given)."""
    by = list(by or [])
    cols = [c for c in snapshot.columns if c not in by]
    return snapshot.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "columns", F.lit(",".join(cols)))


def save_stage(df: DataFrame, root: str, stage: str, run_id: str) -> str:
    """Between-phase state as parquet ``stage=<name>/run_id=<id>``."""
    path = f"{root}/stage={stage}/run_id={run_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_stage(spark: SparkSession, root: str, stage: str, run_id: str) -> DataFrame:
    return (spark.read.option("basePath", root).parquet(root)
            .where((F.col("stage") == stage) & (F.col("run_id") == run_id)).drop("stage", "run_id"))


# ------------------------------------------------------------------ schema conformance
def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add missing columns (default or NULL), cast to the target types (e.g. legacy integer
    clinic/visit ids widened to text) and order columns as the schema."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType) if f.dataType != T.StringType() else F.col(f.name).cast("string")
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ bootstrap CSV
def _nan_text(c: Column) -> Column:
    t = S.strip(c)
    return c.isNull() | (t == "") | (F.lower(t) == "nan")


def _bootstrap_errors(label_col: str = LABEL) -> Column:
    """Array of error codes of one string-typed bootstrap row ('no_label' included)."""
    errs = [F.when(_nan_text(F.col(label_col)), F.lit("no_label"))]
    for c in BOOTSTRAP_INT + BOOTSTRAP_FLOAT:
        v = F.col(c)
        bad = v.isNotNull() & (S.strip(v) != "") & (S.strip(v)).try_cast("double").isNull()
        errs.append(F.when(bad, F.lit(f"invalid_numeric:{c}")))
    for c in BOOTSTRAP_INT:
        errs.append(F.when(F.col(c).isNull() | (S.strip(F.col(c)) == ""), F.lit(f"missing_numeric:{c}")))
    for c in BOOTSTRAP_TEXT:
        errs.append(F.when(_nan_text(F.col(c)), F.lit(f"invalid_text:{c}")))
    return F.array_compact(F.array(*errs))


def _with_report(raw: DataFrame, label_col: str = LABEL) -> DataFrame:
    e = _bootstrap_errors(label_col)
    return raw.select("*", F.array_join(e, ",").alias("errors"),
                      (F.size(F.filter(e, lambda x: x != "no_label")) == 0).alias("is_valid"),
                      (~_nan_text(F.col(label_col))).alias("has_label"))


def bootstrap_validate(raw: DataFrame, label_col: str = LABEL, line_col: str = "line_no") -> DataFrame:
    """Row-level error report of a string-typed bootstrap CSV (rows without a label are
    reported as ``no_label`` and skipped by the ingest)."""
    return _with_report(raw, label_col).select(line_col, "errors", "is_valid", "has_label")


def bootstrap_file_check(raw: DataFrame, cfg: Config = DEFAULT, label_col: str = LABEL) -> DataFrame:
    """File-level checks: required columns, a least number of labelled rows; files of any size are taken."""
    missing = [c for c in BOOTSTRAP_REQUIRED if c not in [x.strip() for x in raw.columns]]
    n = raw.agg(F.count_if(~_nan_text(F.col(label_col))).alias("labelled_rows"))
    msg = (F.when(F.lit(bool(missing)), F.lit(f"Missing columns: {missing}"))
           .when(F.col("labelled_rows") < cfg.bootstrap_min_rows,
                 F.format_string(f"Need at least {cfg.bootstrap_min_rows} rows with non-empty {label_col}; got %d",
                                 F.col("labelled_rows"))))
    return n.select("labelled_rows", msg.alias("file_error"), msg.isNull().alias("file_ok"))


def bootstrap_ingest(raw: DataFrame, as_of, file_id: str, cfg: Config = DEFAULT, label_col: str = LABEL,
                     line_col: str = "line_no", mode: str = "quarantine") -> DataFrame:
    """Aligned (prediction, feedback) rows from a string-typed bootstrap CSV.

    ``mode='strict'`` fails the job on the first invalid row (the reference rejects the whole
    file); ``mode='quarantine'`` keeps the valid rows only.  Ids are sha256(file:line).
    ``created_at`` = midnight(as_of) + i seconds, i = position among labelled rows.
    """
    j = _with_report(raw, label_col).where(F.col("has_label"))
    if mode == "strict":
        j = j.withColumn("errors", F.when(F.col("is_valid"), F.col("errors")).otherwise(
            F.raise_error(F.concat(F.lit("Invalid bootstrap row "), F.col(line_col).cast("string"), F.lit(": "),
                                   F.col("errors")))))
    numbered = O.with_row_number(j, [line_col], "_i")
    good = numbered.where(F.col("is_valid"))
    label = S.strip(F.col(label_col))
    ai_raw = F.col("ai_diagnosis") if "ai_diagnosis" in raw.columns else F.lit(None).cast("string")
    ai = F.when(_nan_text(ai_raw), label).otherwise(S.strip(ai_raw))
    ic_raw = F.col("is_correct") if "is_correct" in raw.columns else F.lit(None).cast("string")
    base = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    mh = S.blank_to_null(F.col("medical_history"))
    return good.select(
        F.sha2(F.concat(F.lit(f"{file_id}:"), F.col(line_col).cast("string")), 256).alias("prediction_id"),
        F.when(S.blank_to_null("pet_id").isNull(), F.lit("bootstrap")).otherwise(S.strip("pet_id")).alias("pet_id"),
        *[S.strip(F.col(c)).alias(c) for c in ("animal_type", "gender")],
        (S.strip("age_months")).try_cast("double").cast("int").alias("age_months"),
        F.coalesce((S.strip("weight_kg")).try_cast("double"), F.lit(float("nan"))).alias("weight_kg"),
        F.coalesce((S.strip("temperature")).try_cast("double"), F.lit(float("nan"))).alias("temperature"),
        (S.strip("heart_rate")).try_cast("double").cast("int").alias("heart_rate"),
        *[S.strip(F.col(c)).alias(c) for c in ("current_season", "vaccination_status")],
        F.coalesce(mh, F.lit("Unknown")).alias("medical_history"),
        (S.strip("symptom_duration")).try_cast("double").cast("int").alias("symptom_duration"),
        F.coalesce(F.col("symptoms_list"), F.lit("")).alias("symptoms_list"),
        label.alias("final_diagnosis"), ai.alias("ai_diagnosis"),
        F.coalesce(S.parse_bool_words(ic_raw), F.lit(True)).alias("is_correct"),
        F.lit("bootstrap_csv").alias("model_version"), F.lit(1.0).alias("confidence_score"),
        F.lit(1.0).alias("data_quality_score"), F.lit(None).cast("int").alias("confidence_rating"),
        F.lit(True).alias("is_training_eligible"),
        (base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("_i") - 1).cast("decimal(18,6)")))
        .alias("created_at"))


# ------------------------------------------------------------------ input contract
# Request fields that must be present (medical_history defaults to Unknown).
CONTRACT_REQUIRED = ("animal_type", "gender", "age_months", "weight_kg", "temperature", "heart_rate",
                     "current_season", "vaccination_status", "symptoms_list", "symptom_duration")


def input_contract_check(predictions: DataFrame, label: Column) -> DataFrame:
    """Violations per rule over logged prediction inputs: required fields, dog/cat domain, label."""
    js = F.col("prediction_input")
    viol = [F.when(F.get_json_object(js, f"$.{f}").isNull(), F.lit(f"missing:{f}")) for f in CONTRACT_REQUIRED]
    at = F.lower(S.strip(F.coalesce(F.get_json_object(js, "$.animal_type"), F.lit(""))))
    viol.append(F.when(~at.isin("dog", "cat"), F.lit("animal_type_domain")))
    viol.append(F.when(label.isNull(), F.lit("label_missing")))
    rows = predictions.select(F.explode(F.array_compact(F.array(*viol))).alias("rule"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
