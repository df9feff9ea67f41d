"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names instead of the headline set
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewire.registry import QUERIES, load_all  # noqa: E402
from tidewire.session import get_session  # noqa: E402

HEADLINE = [
    "event_log_scan",
    "size_fill",
    "throughput",
    "mean_throughput_table",
    "throughput_display",
    "segment_samples",
    "latency_stats",
    "latency_trimmed",
    "counter_rates",
    "resource_usage",
    "log_parse",
    "stats_flatten",
    "scenario_grid",
    "subscription_pairs",
    "payload_generate",
    "payload_roundtrip",
    "workload_table",
    "microbatch_assign",
    "stream_completion",
    "metric_store_roundtrip",
    "stream_throughput",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_session(
        "tidewire-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query so that session start-up is not charged to the first.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
