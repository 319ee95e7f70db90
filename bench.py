"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the
timed runs per query after one warm-up run of all of them; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from viewlens.registry import QUERIES  # noqa: E402
from viewlens.session import build_session  # noqa: E402

HEADLINE = [
    "title_metrics_windowed",
    "daily_engagement_windowed",
    "daily_engagement_windowed_approx",
    "title_metrics_rowtime",
    "daily_engagement_rowtime",
    "title_metrics_latest",
    "hourly_engagement",
    "hourly_engagement_approx",
    "title_metrics_max",
    "daily_title_engagement",
    "daily_engagement_documented",
    "stream_title_metrics",
    "stream_tumbling_day",
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sorted(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = build_session(
        "viewlens-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        run(spark, name, sf_dir)
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total warm median time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
