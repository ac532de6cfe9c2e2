"""Fixture tables derived from the driver's generated tables.

The derivations are portable SQL: the same text runs in Spark (over temp views
of the parquet tables) and in DuckDB (as CTEs over its pre-registered views),
so the operator under test is the only thing that differs between the engine
and the oracle.  Every fixture reads whole driver tables, so its size grows
with the scale factor.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed parameters shared by every fixture query (FIXTURES.md §2).
AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
WINDOW_DAYS = 14
BATCH_T = 10
SEED = 42

_PREDICTION_INPUT = (
    """'{"animal_type":"' || CASE WHEN event_id % 2 = 0 THEN 'dog' ELSE 'cat' END"""
    """ || '","gender":"' || CASE WHEN user_id % 2 = 0 THEN 'Male' ELSE 'Female' END"""
    """ || '","age_months":' || (1 + event_id * 7 % 180)"""
    """ || ',"weight_kg":' || (1 + event_id % 49) || '.5,"temperature":' || (37 + event_id % 4)"""
    """ || '.2,"heart_rate":' || (60 + event_id * 37 % 120)"""
    """ || ',"current_season":"' || CASE WHEN event_id % 4 = 0 THEN 'Spring' WHEN event_id % 4 = 1 THEN 'Summer'"""
    """ WHEN event_id % 4 = 2 THEN 'Fall' ELSE 'Winter' END"""
    """ || '","vaccination_status":"' || CASE WHEN event_id % 3 = 0 THEN 'Overdue' ELSE 'Up to date' END || '"'"""
    """ || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"medical_history":"Healthy"' END"""
    """ || ',"symptom_duration":' || (1 + event_id % 29)"""
    """ || ',"symptoms_list":"' || CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 < 3 THEN 'Fever, cough,, '"""
    """ ELSE 'vomiting,diarrhea' END || '"'"""
    """ || CASE WHEN user_id % 20 = 19 THEN ',"clinicId":"clinic-x"' ELSE '' END || '}'"""
)

_PREDICTION_OUTPUT = (
    """'{"diagnosis":"' || CASE WHEN event_id % 13 = 0 THEN ' ' ELSE event_type END"""
    """ || '","confidence":0.5,"top_k":[' || CASE WHEN event_id % 26 = 0 THEN ''"""
    """ ELSE '{"label":"' || event_type || '","prob":0.5}' END || ']}'"""
)

# name -> portable SELECT.  Order matters: later fixtures may read earlier ones.
FIXTURE_SQL: dict[str, str] = {
    "fx_prediction_log": f"""
SELECT CAST(event_id AS STRING) AS id,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'visit-' || event_id END AS visit_id,
       'pet-' || user_id AS pet_id,
       CASE WHEN user_id % 10 = 9 THEN NULL WHEN user_id % 10 = 8 THEN '  '
            ELSE 'clinic-' || (user_id % 10) END AS clinic_id,
       'v' || (1 + event_id % 3) || '.0' AS model_version,
       CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS confidence_score,
       'vet-' || (event_id % 7) AS veterinarian_id,
       {_PREDICTION_INPUT} AS prediction_input,
       {_PREDICTION_OUTPUT} AS prediction_output,
       '[{{"label":"' || event_type || '","prob":0.5}}]' AS top_k_predictions,
       CAST(ts AS TIMESTAMP) AS created_at
FROM events""",
    "fx_feedback": """
SELECT event_id AS id,
       CASE WHEN event_id % 50 = 1 THEN CAST(event_id + 100000000 AS STRING)
            ELSE CAST(event_id AS STRING) END AS prediction_id,
       CASE WHEN event_id % 4 <> 0 THEN event_type WHEN event_type = 'click' THEN 'view'
            ELSE 'click' END AS final_diagnosis,
       (event_id % 4 <> 0) AS is_correct,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS ai_diagnosis,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 6 AS INT) END AS confidence_rating,
       (event_id % 8 <> 0) AS is_training_eligible,
       CAST(50 + event_id % 51 AS DOUBLE) / 100 AS data_quality_score,
       CASE WHEN user_id % 10 IN (0, 1, 8, 9) THEN 'GLOBAL' ELSE 'CLINIC_ONLY' END AS training_pool,
       CAST(ts AS TIMESTAMP) + INTERVAL 2 HOUR AS created_at
FROM events""",
    "fx_baseline": """
SELECT o_orderkey AS row_id,
       'pet-' || o_custkey AS pet_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'cat' ELSE 'dog' END AS animal_type,
       CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
       CAST(1 + o_orderkey * 7 % 180 AS INT) AS age_months,
       CAST(10 + o_orderkey * 11 % 490 AS DOUBLE) / 10 AS weight_kg,
       CAST(370 + o_orderkey * 13 % 40 AS DOUBLE) / 10 AS temperature,
       CAST(60 + o_orderkey * 37 % 120 AS INT) AS heart_rate,
       CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring'
            WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Fall' END AS current_season,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Overdue' ELSE 'Up to date' END AS vaccination_status,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS medical_history,
       CAST(1 + o_orderkey % 29 AS INT) AS symptom_duration,
       replace(p_name, ' ', ', ') AS symptoms_list,
       CASE WHEN o_orderkey % 40 = 7 THEN 'refund' WHEN o_orderkey * 37 % 120 >= 90 THEN 'error'
            WHEN o_orderkey * 13 % 40 >= 25 THEN 'purchase' WHEN o_orderstatus = 'F' THEN 'click'
            WHEN o_orderstatus = 'O' THEN 'view' ELSE 'signup' END AS target_diagnosis
FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % (SELECT max(p_partkey) FROM part) + 1""",
    "fx_scored": """
SELECT row_id,
       target_diagnosis AS y,
       CASE WHEN row_id % 7 = 0 THEN 'click' ELSE target_diagnosis END AS y_old,
       CASE WHEN row_id % 9 = 0 THEN 'view' ELSE target_diagnosis END AS y_new,
       CAST(20 + row_id * 31 % 80 AS DOUBLE) / 100 AS maxp
FROM fx_baseline""",
    "fx_job": """
SELECT o_orderkey AS training_id,
       CASE WHEN o_orderkey % 100 = 0 THEN 'Cancelled' WHEN o_orderstatus = 'F' THEN 'completed'
            WHEN o_orderstatus = 'O' THEN 'failed' WHEN o_orderkey % 15 = 0 THEN 'running'
            ELSE 'pending' END AS status,
       CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'clinic-' || (o_custkey % 8) END AS clinic_id,
       CAST(o_orderdate AS TIMESTAMP) AS start_time,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 MINUTE
            ELSE NULL END AS end_time,
       CASE WHEN o_orderstatus = 'F' THEN 'v1.' || (o_orderkey % 30) ELSE NULL END AS new_model_version,
       (o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS is_deployed,
       o_orderkey % 60 AS n_samples,
       CAST(600 + o_orderkey * 17 % 400 AS DOUBLE) / 1000 AS validation_f1,
       CASE WHEN o_orderkey % 35 = 0 THEN NULL ELSE CAST(600 + o_orderkey * 29 % 400 AS DOUBLE) / 1000 END
            AS cv_mean_f1_weighted,
       CAST(o_orderkey % 50 AS DOUBLE) / 1000 AS cv_std_f1_weighted
FROM orders""",
    "fx_monitor_log": """
SELECT event_id,
       CASE WHEN user_id % 10 >= 8 THEN NULL ELSE 'clinic-' || (user_id % 10) END AS clinic_id,
       event_type AS prediction,
       CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 OR (event_id % 500) < 8 THEN 'other'
            ELSE event_type END AS actual,
       CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS confidence,
       value / 50 AS latency_seconds,
       CAST(ts AS TIMESTAMP) AS ts
FROM events""",
    "fx_drift_side": """
SELECT CASE WHEN row_id % 2 = 0 THEN 'reference' ELSE 'current' END AS side,
       temperature,
       CASE WHEN row_id % 2 = 0 THEN heart_rate ELSE heart_rate + 25 END AS heart_rate,
       age_months,
       weight_kg,
       CASE WHEN row_id % 2 = 1 AND row_id % 5 = 0 THEN 'cat' ELSE animal_type END AS animal_type,
       gender,
       vaccination_status,
       target_diagnosis
FROM fx_baseline""",
    "fx_bootstrap_raw": """
SELECT row_id,
       CASE WHEN row_id % 109 = 0 THEN '' ELSE pet_id END AS pet_id,
       animal_type,
       CASE WHEN row_id % 107 = 0 THEN 'nan' ELSE gender END AS gender,
       CASE WHEN row_id % 101 = 0 THEN '3.7' ELSE CAST(age_months AS STRING) END AS age_months,
       CAST(weight_kg AS STRING) AS weight_kg,
       CAST(temperature AS STRING) AS temperature,
       CASE WHEN row_id % 103 = 0 THEN 'abc' ELSE CAST(heart_rate AS STRING) END AS heart_rate,
       current_season,
       vaccination_status,
       medical_history,
       symptoms_list,
       CAST(symptom_duration AS STRING) AS symptom_duration,
       CASE WHEN row_id % 97 = 0 THEN ' ' ELSE target_diagnosis END AS target_diagnosis,
       CASE WHEN row_id % 5 = 0 THEN NULL WHEN row_id % 5 = 1 THEN 'nan' WHEN row_id % 5 = 2 THEN ''
            WHEN row_id % 5 = 3 THEN 'click' ELSE target_diagnosis END AS ai_diagnosis,
       CASE WHEN row_id % 4 = 0 THEN 'yes' WHEN row_id % 4 = 1 THEN 'Rejected'
            WHEN row_id % 4 = 2 THEN 'maybe' ELSE NULL END AS is_correct
FROM fx_baseline""",
    # --- dimensions derived from the job / prediction tables (grow with the data) ---
    "fx_pin_d": """
SELECT clinic_id, max_by(new_model_version, training_id) AS version
FROM fx_job WHERE status = 'completed' AND is_deployed GROUP BY clinic_id""",
    "fx_registry_d": """
SELECT c.clinic_id, c.version, TRUE AS has_model, (c.tid % 7 <> 0) AS has_tab, TRUE AS has_symptoms,
       CASE WHEN c.version = pn.version THEN 'production' WHEN c.dep THEN 'archived' ELSE 'staging' END AS status
FROM (SELECT clinic_id, new_model_version AS version, max(training_id) AS tid, bool_or(is_deployed) AS dep
      FROM fx_job WHERE status = 'completed' GROUP BY clinic_id, new_model_version) c
LEFT JOIN fx_pin_d pn ON c.clinic_id IS NOT DISTINCT FROM pn.clinic_id
UNION ALL
SELECT DISTINCT clinic_id,
       'v' || CAST(year(start_time) AS STRING) || lpad(CAST(month(start_time) AS STRING), 2, '0')
           || lpad(CAST(day(start_time) AS STRING), 2, '0') || '_120000' AS version,
       TRUE AS has_model, TRUE AS has_tab, TRUE AS has_symptoms, 'failed' AS status
FROM fx_job WHERE status = 'failed'""",
    "fx_approval_d": """
SELECT training_id AS seq, new_model_version AS version,
       CASE WHEN is_deployed THEN 'approve' WHEN training_id % 7 = 0 THEN 'rollback' ELSE 'reject' END AS action,
       'ops' AS actor, end_time AS event_at
FROM fx_job WHERE status = 'completed' AND clinic_id IS NULL""",
    "fx_catalog_d": """
SELECT 1 AS priority, clinic_id AS id, 'Site ' || upper(clinic_id) AS name
FROM (SELECT DISTINCT clinic_id FROM fx_prediction_log) p
UNION ALL
SELECT DISTINCT 2 AS priority, 'clinic-' || (user_id % 12) AS id, CAST(NULL AS STRING) AS name FROM events""",
    "fx_clinic_inputs_d": """
SELECT DISTINCT upper(clinic_id) AS user_text FROM fx_prediction_log WHERE clinic_id IS NOT NULL
UNION SELECT DISTINCT lower(name) FROM fx_catalog_d WHERE name IS NOT NULL
UNION SELECT DISTINCT '00000000-0000-0000-0000-' || lpad(CAST(user_id AS STRING), 12, '0') FROM events
UNION SELECT DISTINCT 'legacy-' || CAST(user_id % 5 AS STRING) FROM events""",
    # --- literal dimensions (fixed values from FIXTURES.md) ---
    "fx_policy": """
SELECT * FROM (VALUES ('clinic-0', 'GLOBAL'), ('clinic-1', 'GLOBAL'), ('clinic-2', 'CLINIC_ONLY'),
                      ('clinic-3', 'bogus')) AS t(clinic_id, feedback_pool)""",
    "fx_scope_state": """
SELECT scope_key, CAST(last_processed_feedback_id AS BIGINT) AS last_processed_feedback_id,
       CAST(cooldown_until AS TIMESTAMP) AS cooldown_until,
       CAST(consecutive_failures AS INT) AS consecutive_failures
FROM (VALUES ('global:GLOBAL', 500, NULL, 0),
             ('clinic:clinic-2:CLINIC_ONLY', 100, NULL, 1),
             ('clinic:clinic-3:CLINIC_ONLY', 0, TIMESTAMP '2024-02-01 00:00:00', 4),
             ('clinic:clinic-4:CLINIC_ONLY', 0, TIMESTAMP '2024-01-30 00:00:00', 2))
     AS t(scope_key, last_processed_feedback_id, cooldown_until, consecutive_failures)""",
}

# Fixture dependencies on other fixtures (for CTE assembly).
_DEPS = {"fx_scored": ("fx_baseline",), "fx_drift_side": ("fx_baseline",),
         "fx_bootstrap_raw": ("fx_baseline",), "fx_pin_d": ("fx_job",), "fx_registry_d": ("fx_job", "fx_pin_d"),
         "fx_approval_d": ("fx_job",), "fx_catalog_d": ("fx_prediction_log",),
         "fx_clinic_inputs_d": ("fx_prediction_log", "fx_catalog_d")}


def register_base_tables(spark: SparkSession, sf_dir: str) -> None:
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}
        # fixture timestamps are UTC wall-clock values (the oracle's TIMESTAMP is zone-less)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        register_base_tables(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derive(self, sql: str) -> DataFrame:
        """Run a portable derivation over fixture views (registers the ones it names)."""
        for n in FIXTURE_SQL:
            if re.search(rf"\b{n}\b", sql):
                getattr(self, n)
        return self.spark.sql(sql)

    def __getattr__(self, name: str) -> DataFrame:
        key = name if name.startswith("fx_") else f"fx_{name}"
        if key not in FIXTURE_SQL:
            raise AttributeError(name)
        if key not in self._cache:
            for dep in _DEPS.get(key, ()):
                getattr(self, dep).createOrReplaceTempView(dep)
            df = self.spark.sql(FIXTURE_SQL[key])
            df.createOrReplaceTempView(key)
            self._cache[key] = df
        return self._cache[key]


def _needed(sql: str) -> list[str]:
    names = [n for n in FIXTURE_SQL if re.search(rf"\b{n}\b", sql)]
    out: list[str] = []
    for n in FIXTURE_SQL:  # keep declaration order
        if n in names or any(n in _DEPS.get(m, ()) for m in names):
            out.append(n)
    return out


def with_fixtures(sql: str) -> str:
    """Prefix an oracle query with the fixture CTEs it references."""
    body = sql.strip()
    ctes = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in _needed(body)]
    if not ctes:
        return body
    if re.match(r"(?is)^with\s", body):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
