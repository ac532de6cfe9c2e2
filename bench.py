"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built from the registry and fully executed into Spark's ``noop``
sink (every column computed, nothing collected); the best of $BENCH_RUNS (default 2)
runs is reported, so JVM warm-up and code generation are not counted.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "collect_training_frame",
    "eligible_by_clinic",
    "feedback_counts",
    "training_snapshot",
    "upsert_feedback",
    "watermark_batches",
    "auto_batch_plan",
    "feedback_validate",
    "monitor_metrics",
    "error_burst_alerts",
    "hourly_trend",
    "confidence_threshold_sweep",
    "drift_numeric",
    "promotion_guardrail",
    "effective_model",
    "bootstrap_ingest",
    "running_monitor",
    "drift_windows",
    "random_split",
    "train_forest",
    "batch_score",
    "stream_hourly_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="looplake-bench-")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("looplake-bench")
             .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
             .config("spark.local.dir", f"{scratch}/local")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from looplake.plans.registry import load_all

    reg = load_all()
    # warm-up (JVM, codegen caches) on the smallest query
    reg["feedback_by_correct"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for key in HEADLINE:
        best = None
        for _ in range(runs):  # build (including any eager checkpoint) + full execution; best of runs
            t0 = time.perf_counter()
            df = reg[key].build(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[key] = round(best, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
