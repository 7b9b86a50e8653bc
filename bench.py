"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query is run to the end without
fetching its rows; the first query of the list is run once before, to start the JVM.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from geohour.session import clear_scratch, local_session
from workload import QUERIES

HEADLINE = (
    "rolling_sums", "asof_join", "period_lookup", "expand_hours", "agg_hourly_max",
    "join_left_multi", "dedup_first", "describe", "duplicate_rows", "spatial_point_cell",
    "spatial_polygon_cell", "nearest_distance", "knn_radius", "idw_interpolate", "reproject",
    "clean_text", "upsert_max", "compact_chunks", "cell_elevation", "distance_class",
    "flood_history", "rain_features", "gridded_rain", "assemble_dataset",
)


def seconds(spark, sf_dir: str, name: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - begin
    clear_scratch(spark)
    return took


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    seconds(spark, sf_dir, HEADLINE[0])
    took = {}
    for name in names or HEADLINE:
        took[name] = round(statistics.median(
            seconds(spark, sf_dir, name) for _ in range(repeats)
        ), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(sys.argv[1:])
