"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from vaultferry.plans.registry import QUERIES

HEADLINE = (
    "policy_outcomes",
    "policy_outcomes_filtered",
    "archive_routing",
    "idempotency_keys",
    "content_hashes",
    "part_verification",
    "rehydrated_items",
    "checked_parts",
    "messages_flat",
    "pending_items",
    "ingest_receipts",
    "ingest_replay",
    "attempt_rollup",
    "failure_ratio",
    "merge_records",
    "run_summary",
    "archive_summary",
    "error_breakdown",
    "cumulative_ingested",
    "progress_marks",
    "illegal_transitions",
    "reconcile_items",
    "constraint_violations",
    "dry_run_archive_summary",
    "migration_run",
    "stream_ingest_rate",
)


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vaultferry-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="vaultferry-bench-"))
    )
    return builder.getOrCreate()


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "rehydrated_items", sf_dir)  # warm up the JVM and the file cache
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    result = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
    }
    if "migration_run" in seconds:
        items = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
        result["migration_run_items_per_sec"] = round(items / seconds["migration_run"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
