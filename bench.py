"""Time the headline queries on one machine and print one JSON line.

Every query runs over the whole tables into a no-op sink; cached data is cleared
in between.  BENCH_SF_DIR and BENCH_CPUS select the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scoped_read", "normalize_observations", "normalize_frames", "normalize_facility", "border_feed", "aircraft_feed",
    "dedupe_observations", "dedupe_facility", "network_topk", "point_in_polygon", "fence_membership", "grid_membership",
    "track_segments", "entity_classification", "asof_classification", "entry_exit", "dwell_per_entity", "vessel_count",
    "moving_fraction", "replay_snapshots", "headline_series", "all_snapshots", "baseline_comparison", "detected_events",
    "match_labels", "source_health", "health_as_of", "claim_verdicts", "language_audit", "route_questions", "rate_5m",
    "stream_dedupe", "stream_sessions",
]


def main() -> None:
    from fairlead.plans.catalog import catalog
    from fairlead.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog()
    names = sys.argv[1:] or HEADLINE
    queries["rate_5m"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    timings = {}
    for name in names:
        spark.catalog.clearCache()
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
