"""Structured Streaming versions of the monitor, alerting, auto-trigger, upsert and drift.

Every query reads files with an explicit schema, keeps its checkpoint in the
shared checkpoint folder (restartable after executor or driver loss), and
writes to a file sink, so ``Trigger.AvailableNow`` runs are exactly-once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from looplake.config import DEFAULT, Config
from looplake.operators import drift as D
from looplake.operators import monitor as M
from looplake.operators import ordering as O
from looplake.operators import state as ST
from looplake.session import cut_lineage
from looplake.sources.ingest import shared_path

MONITOR_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("clinic_id", T.StringType()),
    T.StructField("prediction", T.StringType()), T.StructField("actual", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("latency_seconds", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
])


def write_files(df: DataFrame, path: str, n_files: int, order_col: str) -> str:
    """Land a table as ``n_files`` arrivals by equal-width ranges of ``order_col``: each range
    is written as its own commit, so file modification times follow the arrival order that a
    file stream source replays.  The table is computed once and kept for its bounds and its ranges."""
    import time

    df = cut_lineage(df)
    b = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    width = (hi - lo + 1) / n_files
    chunk = F.least(F.lit(n_files - 1), F.floor((F.col(order_col) - F.lit(lo)) / F.lit(width)).cast("int"))
    tagged = df.withColumn("_chunk", chunk)
    for i in range(n_files):
        (tagged.where(F.col("_chunk") == i).drop("_chunk").sortWithinPartitions(order_col).coalesce(1)
         .write.mode("append").parquet(path))
        time.sleep(0.05)
    return path


def _run(query_writer, name: str) -> None:
    q = query_writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover
        raise RuntimeError(f"stream {name} failed: {q.exception()}")


# ------------------------------------------------------------------ STR1
def _hourly(rows: DataFrame) -> DataFrame:
    agg = rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(M.correct()).alias("correct"),
        F.count_if(M.labelled()).alias("labelled"), F.avg("confidence").alias("avg_confidence"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "predictions",
                      F.when(F.col("labelled") > 0, F.col("correct") / F.col("labelled")).otherwise(F.lit(0.0))
                      .alias("accuracy"), "avg_confidence")


# The state row of _hourly holds the buffers of its aggregates in their order (avg: sum and count).  Several
# have one name there, so they are renamed by position.
HOURLY_BUFFERS = "struct<predictions:bigint, correct:bigint, labelled:bigint, conf_sum:double, conf_n:bigint>"
HOURLY_SCHEMA = T.StructType([
    T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()),
    T.StructField("predictions", T.LongType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("avg_confidence", T.DoubleType()),
])


def _has_batches(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the stream of this checkpoint has finished a micro-batch."""
    try:
        return not spark.read.text(f"{checkpoint}/commits").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def open_hours(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows still open after the last micro-batch, from the stream's own state store."""
    s = (spark.read.format("statestore").load(checkpoint)
         .select(F.col("key.window").alias("w"), F.col("value").cast(HOURLY_BUFFERS).alias("b")).select("w", "b.*"))
    return s.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "predictions",
                    F.when(F.col("labelled") > 0, F.col("correct") / F.col("labelled")).otherwise(F.lit(0.0))
                    .alias("accuracy"), F.try_divide("conf_sum", "conf_n").alias("avg_confidence"))


def hourly_metrics_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, delay: str = "1 hour",
                          files_per_trigger: int = 1) -> DataFrame:
    """Hourly windows with an event-time watermark, append mode: a window is written once the
    watermark passes its end; rows older than the watermark are dropped as late.  The result also has
    the windows that are still open when the run ends, read from the state store (one row a window; the
    source is not read again); they are not written, so the next run closes them with the rows that arrive
    until then.  A source without rows gives no windows."""
    s = (spark.readStream.schema(MONITOR_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
         .withWatermark("ts", delay))
    _run(_hourly(s).writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint), "hourly_metrics")
    if not _has_batches(spark, checkpoint):
        return spark.createDataFrame([], HOURLY_SCHEMA)
    return spark.read.schema(HOURLY_SCHEMA).parquet(sink).unionByName(open_hours(spark, checkpoint))


# ------------------------------------------------------------------ STR2
BURST_TAIL = T.StructType([
    T.StructField("monitor_key", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("w", T.IntegerType()), T.StructField("pos", T.LongType()),
])
BURST_OUT = T.StructType([
    T.StructField("monitor_key", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("recent_errors", T.IntegerType()),
])


def error_burst_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_trigger: int = 1,
                       block: int = O.DEFAULT_BLOCK) -> DataFrame:
    """Wrong rows with >= 5 wrong among the last 10 of their monitor key (clinic, or 'global'), micro-batches
    in arrival order, by (ts, event_id) inside each.

    The state is a table of each key's last nine rows, one version a micro-batch.  A micro-batch is put
    behind the tails before it, numbered by range partitions and counted in blocks of rows, so a key that
    has all rows of a micro-batch is spread over tasks.  A micro-batch that is run again reads the same
    tails and writes the same folders anew."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        sp = batch.sparkSession
        rows = batch.select(F.coalesce(F.col("clinic_id"), F.lit("global")).alias("monitor_key"), "event_id", "ts",
                            F.coalesce(M.wrong(), F.lit(False)).cast("int").alias("w"), F.lit(0).cast("long").alias("pos"),
                            F.lit(True).alias("fresh"))
        if batch_id > 0:
            rows = rows.unionByName(sp.read.schema(BURST_TAIL).parquet(f"{sink}/tails/batch={batch_id - 1}")
                                    .withColumn("fresh", F.lit(False)))
        n = O.with_row_number(rows, ["fresh", "pos", "ts", "event_id"], "rn", partition_cols=["monitor_key"])
        s = O.trailing_sum(n, "rn", F.col("w"), M.BURST_WINDOW, "recent_errors", ["monitor_key"], block)
        (s.where(F.col("fresh") & (F.col("w") == 1) & (F.col("recent_errors") >= M.BURST_MIN_ERRORS))
         .select("monitor_key", "event_id", "ts", F.col("recent_errors").cast("int").alias("recent_errors"))
         .write.mode("overwrite").parquet(f"{sink}/alerts/batch={batch_id}"))
        newest = Window.partitionBy("monitor_key").orderBy(F.col("rn").desc())  # limited before the shuffle
        (n.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") < M.BURST_WINDOW)
         .select("monitor_key", "event_id", "ts", "w", F.col("rn").alias("pos"))
         .write.mode("overwrite").parquet(f"{sink}/tails/batch={batch_id}"))

    s = spark.readStream.schema(MONITOR_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    _run(s.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), "error_burst")
    if not _has_batches(spark, checkpoint):
        return spark.createDataFrame([], BURST_OUT)
    return spark.read.schema(BURST_OUT).parquet(f"{sink}/alerts").select(*BURST_OUT.fieldNames())


# ------------------------------------------------------------------ STR3
FEEDBACK_EVENT_SCHEMA = T.StructType([
    T.StructField("scope_key", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("is_training_eligible", T.BooleanType()), T.StructField("created_at", T.TimestampType()),
])
TRIGGER_STATE = T.StructType([T.StructField("last_id", T.LongType()), T.StructField("pending", T.ArrayType(T.LongType()))])
TRIGGER_OUT = T.StructType([
    T.StructField("scope_key", T.StringType()), T.StructField("batch_start_feedback_id", T.LongType()),
    T.StructField("batch_end_feedback_id", T.LongType()), T.StructField("batch_ids", T.StringType()),
    T.StructField("idempotency_key", T.StringType()),
])


def _make_trigger_fn(batch_size: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True)
        last_id, pending = state.get if state.exists else (int(pdf["start_id"].iloc[0]), [])
        ids = pdf.loc[pdf["is_training_eligible"].fillna(True).astype(bool), "id"].to_numpy(np.int64)
        pending, out = np.union1d(np.array(pending, np.int64), ids[ids > last_id]).tolist(), []
        full = 0 if pdf["cooling"].any() else len(pending) // batch_size
        for k in range(full):
            batch = pending[k * batch_size:(k + 1) * batch_size]
            key_hex = hashlib.sha256(json.dumps(batch, separators=(",", ":")).encode("utf-8")).hexdigest()
            out.append((key[0], batch[0], batch[-1], ",".join(map(str, batch)), key_hex))
            last_id = batch[-1]
        state.update((last_id, pending[full * batch_size:]))
        yield pd.DataFrame(out, columns=[f.name for f in TRIGGER_OUT.fields])
    return fn


def auto_trigger_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, cfg: Config = DEFAULT,
                        files_per_trigger: int = 1, start: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Keyed state per scope {watermark id, pending ids}; emits one job request per full batch of T
    eligible ids with its idempotency key (replays are harmless: the key is the sink's de-duplication
    key).  A scope's watermark starts at its ``last_processed_feedback_id`` in ``start``, a table of scope
    states with one row per scope, else at 0, so nothing depends on how ids in order are cut into files.
    A scope whose ``cooldown_until`` there lies after ``now`` (the time of the micro-batch, if not given)
    gathers its ids; they are batched with its first feedback after the cooldown (no timer: a query with
    processing-time timers never ends under ``Trigger.AvailableNow``)."""
    s = spark.readStream.schema(FEEDBACK_EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    if start is None:
        s = s.withColumn("start_id", F.lit(0).cast("long")).withColumn("cooling", F.lit(False))
    else:
        until = F.col("cooldown_until") if "cooldown_until" in start.columns else F.lit(None)
        known = start.select("scope_key", F.col("last_processed_feedback_id").cast("long").alias("start_id"),
                             until.cast("timestamp").alias("_until"))
        s = s.join(known, "scope_key", "left").withColumn("start_id", F.coalesce("start_id", F.lit(0))) \
            .withColumn("cooling", F.coalesce(F.col("_until") > (F.current_timestamp() if now is None else now), F.lit(False))).drop("_until")
    out = s.groupBy("scope_key").applyInPandasWithState(
        _make_trigger_fn(cfg.auto_batch_size), TRIGGER_OUT, TRIGGER_STATE, "append", GroupStateTimeout.NoTimeout)
    _run(out.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint), "auto_trigger")
    return spark.read.parquet(sink).dropDuplicates(["idempotency_key"])


# ------------------------------------------------------------------ STR4
MANIFEST = "bucket int, written long"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _write_version(rows: DataFrame, root: str, version: int, key: str, buckets: int, kept: list) -> None:
    """Rows of whole buckets as ``version``, then the manifest: bucket -> version that wrote it."""
    (rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v={version}"))
    spark = rows.sparkSession
    written = spark.read.schema("bucket int").parquet(f"{root}/data/v={version}").distinct() \
        .withColumn("written", F.lit(version).cast("long"))
    spark.createDataFrame(kept, MANIFEST).unionByName(written).coalesce(1) \
        .write.mode("overwrite").parquet(f"{root}/manifest/v={version}")


def _read_manifest(spark: SparkSession, root: str, version: int) -> list:
    """At most one row a bucket."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v={version}").collect()


def _read_buckets(spark: SparkSession, root: str, schema: T.StructType, entries: list) -> DataFrame:
    paths = [f"{root}/data/v={e.written}/bucket={e.bucket}" for e in entries]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_feedback_stream(spark: SparkSession, source: str, schema: T.StructType, target_root: str,
                           initial: DataFrame, checkpoint: str, as_of, files_per_trigger: int = 1,
                           buckets: int = 32) -> DataFrame:
    """foreachBatch applies the feedback upsert to a target kept as ``buckets`` hash buckets of
    prediction_id.  Micro-batch ``b`` reads and writes only the buckets that have changes; its manifest takes
    them as written by ``b`` and all others as they were, so bytes follow the changes, not the target.
    Running a micro-batch again starts from the manifest before it and writes the same version.
    ``initial`` is written when the stream has no finished micro-batch yet, else the target stands as it is.
    Choose ``buckets`` so that a bucket has some 100 MB; the number stays fixed for a target."""
    key, cols = "prediction_id", initial.schema
    if not _has_batches(spark, checkpoint):
        _write_version(initial, target_root, -1, key, buckets, [])

    def apply(batch: DataFrame, batch_id: int) -> None:
        sp = batch.sparkSession
        touched = {r.bucket for r in batch.select(_bucket(key, buckets)).distinct().collect()}  # at most ``buckets``
        before = _read_manifest(sp, target_root, batch_id - 1)
        cur = _read_buckets(sp, target_root, cols, [e for e in before if e.bucket in touched])
        _write_version(ST.upsert_feedback(cur, batch, as_of), target_root, batch_id, key, buckets,
                       [tuple(e) for e in before if e.bucket not in touched])

    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    _run(s.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), "upsert_feedback")
    versions = spark.read.schema(MANIFEST + ", v long").parquet(f"{target_root}/manifest")
    last = versions.agg(F.max("v")).first()[0]
    return _read_buckets(spark, target_root, cols, _read_manifest(spark, target_root, last))


# ------------------------------------------------------------------ STR5
def drift_stream(spark: SparkSession, source: str, schema: T.StructType, reference: DataFrame, sink: str,
                 checkpoint: str, files_per_trigger: int = 1) -> DataFrame:
    """foreachBatch: numeric drift of each micro-batch against the static reference."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        r = D.drift_numeric(reference, batch).withColumn("batch_id", F.lit(batch_id))
        r.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    _run(s.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), "drift")
    return spark.read.parquet(sink).drop("batch")


def scratch(spark: SparkSession, name: str) -> dict:
    base = shared_path(spark, name)
    return {"source": f"{base}/source", "sink": f"{base}/sink", "checkpoint": f"{base}/checkpoint",
            "target": f"{base}/target"}
