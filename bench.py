"""Headline queries on the driver tables; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Rows are counted through the no-op sink, so results are computed but not moved to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "ground_grid", "roof_height", "points_in_polygons", "nearest_join", "nearest_segment", "dbscan", "cluster_within",
    "exact_percentiles", "hash_ranked_sample", "resample_polyline", "build_road_graph", "signal_state_at", "fit_homography",
    "associate_tracks", "arrivals_by_stop", "stop_routes", "corridor_ahead", "self_within_distance", "obb_overlap", "episode_metrics",
)


def main() -> None:
    from metroframe.catalog import QUERIES
    from metroframe.session import get_spark

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        }
    )
    spark.range(1000).repartition(int(cpus)).mapInPandas(lambda it: it, "id long").count()  # start the Python workers
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
