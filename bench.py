"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_QUERIES: comma-separated names to run instead of the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadflow.catalog import QUERIES  # noqa: E402
from roadflow.session import local_session  # noqa: E402

HEADLINE = [
    "processed_table", "interp_limit", "vehicle_features", "traffic_by_key", "dedup_exact", "dedup_id",
    "resample_5min", "resample_lineitem_daily", "rolling_lineitem_daily", "asof_nearest", "speed_boxplot",
    "corr_matrix", "top_nodes", "hourly_volume_by_interval", "model_features", "order_search", "train_eval",
    "backtest_table", "stream_resample", "stream_extend",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, int(cores))
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roadflow-bench-"))
    QUERIES["traffic_by_key"](spark, folder).write.mode("overwrite").format("noop").save()  # warm the JVM
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.mode("overwrite").format("noop").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
