"""Time the headline queries and print one JSON line.

Each query runs once untimed (class loading, code generation) and then REPEATS times; the
median counts. Results go to Spark's no-op sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from areametrics.plans.catalog import queries  # noqa: E402
from areametrics.session import session  # noqa: E402

HEADLINE = [
    "occurrence_table", "grid_sjoin", "layer_sjoin_cells", "layer_sjoin_points", "plot_sjoin",
    "park_richness", "taxa_richness_by_grid", "shannon_index", "park_metrics", "grid_metrics",
    "plot_metrics", "park_taxa", "annual_observations", "most_observed_species", "total_species",
    "clip_points", "clip_plots", "dissolve_plots", "reproject_mtm8", "reproject_plots",
    "csv_to_parquet", "geojson_roundtrip", "profile_nulls", "choropleth_features",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g", spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    times = {}
    for name in wanted:
        runs = []
        for i in range(REPEATS + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
