"""Benchmark: fact build, then the reports over the persisted fact.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per key, median reported, default 3), BENCH_WARMUP (rounds of
the whole workload run untimed first, so the JVM's JIT has compiled the hot paths;
default 1; with 0, each key gets one untimed run of its own instead).

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
``value`` is the sum of the per-key medians.  Every key is forced to full
evaluation with the ``noop`` sink (nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from custlens.catalog import REPORTS  # noqa: E402
from custlens.config import DRIVER_PARAMS  # noqa: E402
from custlens.plans.context import Analysis  # noqa: E402
from custlens.sources.store import read_fact, write_fact  # noqa: E402

HEADLINE = [
    "customer_aggregates", "customer_kpis", "top10_revenue", "monthly_trend", "rfm_scores",
    "cohort_retention", "churn_by_region", "monthly_churn_trend", "churned_customer_details",
    "new_vs_returning", "customer_clv", "pareto", "tenure_histogram", "order_frequency_histogram",
    "weekday_revenue", "top_customers_per_region", "recommend_customers", "customer_profile",
    "customer_monthly_history", "product_category_mix", "filter_options", "export_customer_details",
]


def _session(cpus: int, scratch: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("custlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus * 2))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.local.dir", os.path.join(scratch, "local"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "checkpoints"))
    return spark


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _timed(fn, runs: int, warm_up: bool) -> float:
    if warm_up:
        fn()
    samples = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        samples.append(time.perf_counter() - t0)
    return round(statistics.median(samples), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None

    scratch = tempfile.mkdtemp(prefix="custlens-bench-", dir="/tmp")
    spark = _session(cpus, scratch)
    params = DRIVER_PARAMS
    fact_path = os.path.join(scratch, "fact")

    times: dict[str, float] = {}

    def build() -> None:
        write_fact(Analysis.from_fixture(spark, sf_dir, params).fact, fact_path)

    warmup_rounds = int(os.environ.get("BENCH_WARMUP", "1"))
    # After a whole-workload warm-up round, keys need no warm-up of their own.
    per_key_warmup = warmup_rounds == 0
    for _ in range(warmup_rounds):
        build()
        warm = Analysis.from_store(spark, fact_path, params)
        for key in HEADLINE:
            _noop(REPORTS[key](warm))

    times["fact_build"] = _timed(build, runs, per_key_warmup)

    def end_to_end() -> None:
        _noop(REPORTS["top10_revenue"](Analysis.from_fixture(spark, sf_dir, params)))

    times["end_to_end_top10_from_raw"] = _timed(end_to_end, runs, per_key_warmup)

    def report_fn(key):
        def run() -> None:
            _noop(REPORTS[key](Analysis.from_store(spark, fact_path, params)))

        return run

    for key in HEADLINE:
        times[key] = _timed(report_fn(key), runs, per_key_warmup)

    def dashboard() -> None:
        # Every headline report over one analysis whose customer table is stored once.
        a = Analysis.from_store(spark, fact_path, params).store_customers()
        for key in HEADLINE:
            _noop(REPORTS[key](a))

    times["dashboard_all_reports_cached"] = _timed(dashboard, 1, per_key_warmup)

    fact_rows = read_fact(spark, fact_path).count()
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(v for k, v in times.items() if k != "dashboard_all_reports_cached"), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "runs": runs,
        "fact_rows": fact_rows,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
