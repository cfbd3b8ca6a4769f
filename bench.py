"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Prints one JSON line.  Every query is run once to warm up and then timed; its
rows go to the no-op sink, so that all of them are computed and none are moved
to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a1_aggregate_by_source", "a5_digest_per_video", "a6_scene_summaries", "a2_derived_metrics",
    "g4_events_from_results", "p14_attribute_encoding", "p16_gauge_points", "s9_sample_frames",
    "j9_previous_sampled_frame", "j1_detections_in_zones", "a7_zone_counts", "w2_suppress_any_label",
    "w3_suppress_per_label", "m3_density_clusters", "m4_connected_components", "m1_centroid_tracks",
    "a12_flow_summary", "m8_exact_homographies", "j8_rank_models", "j12_nearest_frames",
    "m9_index_frames", "a14_detections_per_model", "u1_batch_inference", "s5_event_table_sink",
    "x1_channel_histograms", "x2_colour_blobs", "x4_foreground", "x5_spot_features",
    "t1_stream_inference", "u5_run_routines",
]


def main() -> None:
    from aerospark.session import build_session
    from workload import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    frames = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    per_minute = {
        name: round(frames * 60 / seconds[name])
        for name in ("g4_events_from_results", "a7_zone_counts", "w2_suppress_any_label",
                     "m3_density_clusters", "m1_centroid_tracks")
        if seconds.get(name)
    }
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": total, "unit": "sec",
                "queries": seconds, "frames": frames, "frames_per_minute": per_minute,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
