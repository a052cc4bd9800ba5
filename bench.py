"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores,
``BENCH_ONLY`` a comma list of query names. Each query runs once to warm up and
once for the clock; results go to the ``noop`` sink so that every row is made.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from trackloom.plans import all_queries  # noqa: E402

HEADLINE = [
    "hop_rms", "normalize_signals", "detect_onsets", "estimate_beats", "sample_signal",
    "sync_mean", "novelty", "select_repeats", "fill_gaps", "owner_span", "smooth_route",
    "frame_params", "known_lines", "lrc_cues", "evaluate", "active_cue", "rule_ordered_ranges",
    "cache_key", "compare_variants", "union_length",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    warm = os.environ.get("BENCH_WARM", "1") != "0"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        for timed in ([False, True] if warm else [True]):
            started = time.perf_counter()
            queries[name](spark, root).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            if timed:
                times[name] = round(took, 3)
                print(f"{name} {took:.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(root).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
