"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice and is written to a sink that keeps nothing; the better time
counts, so that the first run's code generation is not measured.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wardspark.queries import QUERIES  # noqa: E402
from wardspark.session import build_session  # noqa: E402

HEADLINE = (
    "input_scan", "verdict_summary", "output_scan", "page_scan", "corpus_scan", "pii_counts",
    "policy_first_match", "policy_rule_join", "rate_limit", "daily_quota", "quota_policy_fold",
    "holdback_buffer", "stream_abort", "stream_timing", "sse_deltas", "decide_complete",
    "latency_histogram", "rate_per_second", "load_report", "live_rate_limit",
)


def run(spark, folder, name):
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
            "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    times = {name: round(min(run(spark, folder, name) for _ in range(2)), 3) for name in names}
    text_mb = sum(
        os.path.getsize(f"{folder}/{t}.parquet") for t in ("documents", "pages", "conversations")
    ) / 1e6
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
        "text_parquet_mb": round(text_mb, 1),
    }))


if __name__ == "__main__":
    main()
