"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from looplake.session import cut_lineage, ensure_checkpoint_dir

#: Words are maximal runs without the ASCII white space characters.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: crc32 of the key's text divisible by 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, survives
    the loss of executors and, unlike an RDD checkpoint, is computed once and stays columnar."""
    path = shared_folder(df.sparkSession, "stage")
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows from now on: texts may be long, and a batch
    stands in the executor's and the worker's memory as a whole."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def give_back() -> None:
    """Return what a finished task has freed to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` splits at the six ASCII spaces only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z (and nothing else) in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


__all__ = ["SPACES", "batch", "cut_lineage", "give_back", "held_out", "lower_words", "materialize", "shared_folder",
           "table", "text_batches", "words_of"]
