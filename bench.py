"""Times the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
names as arguments choose other queries, `all` times every registered one.
"""

import json
import os
import sys
import time

from trackframe.plans.catalog import QUERIES
from trackframe.session import local_session

HEADLINE = [
    "hourly_direction_difference", "clip_direction_rates", "clip_speed_means", "track_speeds", "frame_encounters",
    "movement_directions", "unmasked_rows", "flux_field", "daily_cumulative_flux", "hour_similarity_cosine",
    "angle_histograms", "hour_pair_distances", "hourly_rate_intervals", "speed_count_correlation",
    "greedy_matches", "detection_quality", "precision_recall_curve", "behaviour_features", "extended_features",
    "id_swap_repairs", "trail_activity", "trail_lagged_correlations", "start_point_clusters", "linked_tracks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the session
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
