"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import time

from tests.session import session
from tripweave.plans import catalog

# BENCH_SEARCH_RADIUS=inf times the searches without the derived network's radius.
OPTIONS = {"search_radius": float(r)} if (r := os.environ.get("BENCH_SEARCH_RADIUS")) else {}
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
# The first query that needs the shared searches, paths or incidence pays for them.
HEADLINE = (
    "network_load", "shortest_dist", "cost_matrix", "gravity_od", "assign_v2", "shortest_paths", "counted_incidence",
    "edge_volume_counted", "gravity_od_k", "simplex_objective", "calibrate_gm", "calibrate_fr", "calibrate_pr",
    "calibrate_lagrange", "chain_contraction",
)


def main() -> None:
    spark = session()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](catalog.driver_network(spark, SF_DIR, **OPTIONS)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(found.group(1)) if found else SF_DIR,
    }))


if __name__ == "__main__":
    main()
