"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query is built and fully executed without being collected; two small runs warm the session up."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["agg_visited", "trk_tiles", "trk_segments", "win_tile_first_visit", "win_history_frames", "win_max_square", "win_max_cluster", "agg_sport_totals", "agg_eddington_cycling", "agg_eddington_running",
            "agg_eddington_walking", "bdg_all", "win_duplicate_groups", "agg_best_copy", "jn_point_in_area", "jn_track_areas", "jn_place_visits", "jn_checkpoint_hits", "jn_climb_match", "agg_message_fold",
            "win_find_climbs"]


def main() -> None:
    from wayfold.session import builder
    from workload import all_queries
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    known, times = all_queries(), {}

    def run(name, where):
        begin = time.time()
        known[name](spark, where).write.format("noop").mode("overwrite").save()
        return round(time.time() - begin, 3)

    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in ("agg_visited", "agg_eddington_cycling"):
        run(name, small if os.path.isdir(small) else sf)
    for name in only or HEADLINE:
        times[name] = run(name, sf)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
