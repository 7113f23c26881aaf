"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from capturemill.plans import CATALOG
from capturemill.session import build_session

HEADLINE = [
    "match_report", "covisibility", "neighbor_views", "matching_summary", "top_pairs", "name_pairs",
    "feature_summary", "registration_summary", "reprojection_by_image", "track_length_stats", "min_views",
    "classify", "run_metrics", "registration_progress", "log_times", "match_descriptors",
    "bounds", "crop_to_roi", "voxel_thin", "split_subscenes", "camera_frustums",
    "dense_first_seen_index", "unpack_obj_vertices", "face_geometry", "boundary_edges", "smooth_mesh",
    "estimate_normals", "sample_mesh", "hole_count", "downscale_plan", "stage_outcome",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        spent = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - started)
        # the first run warms up code generation and files
        times[name] = round(statistics.median(spent[1:] or spent), 3)
    print(json.dumps({
        "metric": "total warm seconds over headline queries, median of runs",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
