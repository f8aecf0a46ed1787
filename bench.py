"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and three times to be timed (the median counts); results are computed in full and
thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from attestry.plans import catalogue

HEADLINE = """flagship filter_conjunction filter_null_drop agg_sum agg_mean_half_even agg_multi agg_chained canonical_position row_digests multiset_digest table_digest
result_parity order_inversions numeric_coercion float64_fidelity failure_rollup chart_signals ledger_blob_join ledger_orphans attempt_shape_violations hash_drift
replay_status formula_samples formula_column spec_admission scan_gates token_bucket stream_rates""".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps({
            "metric": "sum of median query seconds",
            "value": round(sum(took.values()), 3),
            "unit": "sec",
            "queries": took,
            "sf": os.path.basename(sf_dir.rstrip("/")),
        }),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
