"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the cores.  Every query
runs in full into a sink that discards rows; one untimed query warms up the JVM.
``build`` holds the part of each time that went into building the plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jsonloom.config import local_session  # noqa: E402
from jsonloom.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "expand_events_k",
    "jsonl_tolerant_stats",
    "auto_format",
    "summary_named",
    "nodes_by_path_kind",
    "nested_array_nodes",
    "double_layer",
    "restore_all",
    "materialise_expanded",
    "format_pretty",
    "visible_rows_collapsed",
    "search_literal",
    "restore_paths",
    "many_open_paths",
    "copy_container",
    "search_ranges",
    "search_documents",
    "kth_match",
    "path_profile",
    "nesting_histogram",
    "flatten_columns",
    "round_trip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    records = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times, build = {}, {}
    QUERIES[HEADLINE[0]](spark, sf_dir).limit(1).collect()
    for name in HEADLINE:
        start = time.perf_counter()
        frame = QUERIES[name](spark, sf_dir)
        build[name] = round(time.perf_counter() - start, 3)
        frame.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    nodes_time = times["nodes_by_path_kind"]
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "build": build,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "records_per_sec": round(records / nodes_time),
                "nodes_per_sec": round(6 * records / nodes_time),
            }
        )
    )


if __name__ == "__main__":
    main()
