"""What a reader of the training frame repeats, how often inputs are parsed and tables computed, files of an export."""

import glob

from pyspark.sql import functions as F

from looplake.operators import scope as SC
from looplake.operators import trainset as TS
from looplake.sources import ingest as I
from looplake.streaming import streams as STR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_picks_are_not_taken_again_by_every_reader(spark):
    base = spark.range(50).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("target_diagnosis"),
                                  *[F.lit(1).alias(c) for c in TS.FEATURES])
    base = base.withColumn("medical_history", F.lit("x")).withColumn("symptoms_list", F.lit(""))
    frame = spark.createDataFrame([("s", "c0")], "scope_key string, label string").select(
        "scope_key", F.lit("feedback").alias("source"), F.lit("f:1").alias("row_key"), *[F.lit(None).cast(base.schema[c].dataType).alias(c)
                                                                                  for c in TS.FEATURES],
        "label", F.lit(1.0).alias("weight"), F.lit(None).cast("timestamp").alias("sample_ts"))
    out = TS.complete_classes(TS.mix_core_memory(frame, base), base)
    assert "WindowGroupLimit" not in plan(out) and "TakeOrdered" not in plan(out) and "Range (0, 50" not in plan(out)
    assert {r.label for r in out.collect()} == {"c0", "c1", "c2"}


def test_prediction_inputs_are_parsed_once(spark):
    rows = spark.createDataFrame([("1", '{"animal_type":"dog","age_months":3}')], "id string, prediction_input string")
    out = SC.extract_features(rows)
    assert plan(out).count("from_json(") == 1
    r = out.first()
    assert (r.animal_type, r.age_months, r.gender, r.medical_history, r.symptoms_list) == ("dog", 3, None, "Unknown", "")


def test_landed_table_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    STR.write_files(spark.range(100).mapInArrow(passed, "id long"), str(tmp_path / "landed"), 4, "id")
    assert seen.value == 100
    assert spark.read.parquet(str(tmp_path / "landed")).count() == 100


def test_export_has_one_file_a_folder(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select((F.col("id") % 20).alias("training_id"), F.col("id").alias("v"))
    path = I.dataset_export(rows, str(tmp_path / "export"))
    assert len(glob.glob(f"{path}/training_id=*/*.csv")) == 20
    assert spark.read.option("header", True).csv(path).count() == 400
