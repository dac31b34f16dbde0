"""Headline queries, one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "lod_keys": "zoom key backfill", "way_length": "geometry at load", "box_categories": "box query", "selection_ledger": "box query with ledger",
    "box_statistics": "candidate scan", "population_grid": "population grid", "station_catchment": "catchments", "road_edges": "road graph",
    "way_congestion": "road graph congestion", "segment_crossings": "crossings", "tile_cut": "tile cut", "merged_parts": "part merge", "tile_coverage": "tile coverage",
    "baked_tiles": "tile bake", "itineraries": "itineraries", "punctuality": "delays",
}


def main() -> None:
    from streetloom import catalog
    from streetloom.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries = catalog.queries()
    # Warm the JVM on a query that is not measured.
    queries["valid_coordinates"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
