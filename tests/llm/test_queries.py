"""The registered queries: oracles on whole tables, held-out accuracy, the pipeline in plain Python."""

import importlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from looplake.llm import pieces, queries
from looplake.plans.oracle_check import duckdb_run, normalize
from tests.conftest import SF_SMALL
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    assert normalize(df.columns, [tuple(r) for r in df.collect()]) == normalize(*duckdb_run(SF_SMALL, queries.ORACLES[name]))


def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)


def test_language_held_out(spark):
    got = queries.op4_language_id(spark, SF_SMALL).join(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)


def test_pieces_round_trip(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_sentencepiece(spark, SF_SMALL).collect()}
    for r in docs.select("doc_id", F.sha2(F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " "), 256).alias("h")).collect():
        assert got[r.doc_id].decoded_sha256 == r.h


def test_pipeline_equals_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    docs = [(i, t) for i, _, _, t in brute.dedup(brute.quality_filter(docs))]
    root = brute.components(docs)
    docs = [(i, t) for i, t in docs if root[i][1] == i]
    found = brute.contained(docs, items)
    encoder = pieces.Encoder(pieces.load(queries.VOCABULARY))
    want = {i: encoder.encode(t) for i, t in docs if not found[i]}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got.keys() == want.keys()
    assert all(pieces.np.array(got[i], "int32").tobytes() == w for i, w in want.items())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, SF_SMALL)
        assert docs_out.columns == docs.columns


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(importlib.import_module("looplake").__file__)
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, f)) as source:
                    assert "looplake.llm" not in source.read(), f
