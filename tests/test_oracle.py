"""Every SQL-expressible key against its DuckDB oracle; rows-only keys must run.

By default a representative subset runs (fast); ``LOOPLAKE_FULL_ORACLE=1`` runs all keys.
"""

import os

import pytest

from conftest import SF_ORACLE, SF_SMALL
from looplake.plans.oracle_check import compare
from looplake.plans.registry import load_all

REG = load_all()
SUBSET = ["eligible_by_clinic", "feedback_counts", "training_snapshot", "upsert_feedback", "watermark_batches",
          "collect_training_frame", "random_split", "confidence_threshold_sweep", "promotion_guardrail",
          "monitor_metrics", "error_burst_alerts", "running_monitor", "drift_numeric", "effective_model",
          "bootstrap_ingest", "auto_batch_plan", "stream_hourly_metrics", "job_status", "low_confidence_alerts",
          "dataset_export", "assemble_features", "stream_error_burst", "stream_auto_trigger"]
FULL = os.environ.get("LOOPLAKE_FULL_ORACLE") == "1"
SQL_KEYS = sorted(k for k, e in REG.items() if e.sql and (FULL or k in SUBSET))


@pytest.mark.parametrize("key", SQL_KEYS)
def test_oracle(spark, key):
    r = compare(spark, SF_ORACLE if FULL else SF_SMALL, REG[key])
    assert r["columns_match"], (r["spark_cols"], r["oracle_cols"])
    assert r["rows_spark"] == r["rows_oracle"]
    assert r["values_match"], (r["diff"], r["diff_oracle"])


def test_every_key_has_a_builder_and_sql_keys_are_a_subset():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 160


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "label" in df.columns and "weight" in df.columns
