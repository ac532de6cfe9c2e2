"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, encoding.

Every stage takes what the stage before it kept, its decisions take effect, and its result is
written as Parquet in the shared folder and read again.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looplake.llm import decontam, jaccard, linededup, pieces, quality
from looplake.llm.common import materialize, table
from looplake.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines leave their documents, rejected documents leave the corpus."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in the one with the largest id."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = linededup.dedup_lines(docs, carry=rest)
    cols = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")} \
        | {c: F.col(f"carried.{c}") for c in rest}
    return out.select(*(cols[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id stays."""
    gone = jaccard.near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a test item leave the corpus."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    return pieces.encode_documents(docs, VOCABULARY)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates),
          ("decontamination", decontaminate), ("sentencepiece", encode)]

#: The unigram segmentation cannot be told in SQL: the pipeline is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
