"""Headline queries, timed end to end into a null sink. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
The fixture views are stored as partitioned Parquet first, untimed, so that operators are timed.
Each query first runs on the smallest data beside BENCH_SF_DIR, so that class loading and code
generation are not timed, then once on BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assetlane import build_session
from assetlane.suite import load_cases
from assetlane.suite.fixtures import stage_views

HEADLINE = [
    "ssim", "recommend", "sweep_summary", "bar_percent", "effective_dpi", "resolve_outcomes",
    "dedupe_images", "ctm_walk", "reuse_hits", "validate_settings", "debounce_edits",
    "drop_superseded", "intake_filter", "archive_paths", "resolve_mime", "box_downscale",
    "resize_lanczos3", "run_encodes", "ssim_packed", "resize_packed_lanczos3",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="20g",
        spark__sql__shuffle__partitions=str(2 * int(cpus)),
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else sf_dir
    for folder in {warm, sf_dir}:
        stage_views(spark, folder, 2 * int(cpus))
    cases, times = load_cases(), {}
    for name in names:
        cases[name].run(spark, warm).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        cases[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
