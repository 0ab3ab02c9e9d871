"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], each as the median of up to $BENCH_REPEATS runs
within $BENCH_SECONDS; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.spark_queries import QUERIES  # noqa: E402

HEADLINE = (
    "discover_tgfds",
    "presence_by_tuple",
    "constant_dependencies",
    "one_hot_presence",
    "motif_match",
    "pattern_support",
    "edges_with_vertices",
    "frequent_edge_types",
    "degrees",
    "parse_triples",
    "build_vertices",
    "graph_counts",
    "integrate_rdf",
    "filter_high_degree",
    "sample_edges",
    "stable_sample_edges",
    "custom_graph_imdb",
    "partition_by_vertex_type",
    "partition_by_edge_label",
    "partition_by_anchor_type",
    "partition_edges_2d",
    "write_partitions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    budget = float(os.environ.get("BENCH_SECONDS", "900"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kairograph-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the executors
    runs: dict[str, list[float]] = {name: [] for name in names}
    began = time.perf_counter()
    for turn in range(repeats):
        for name in names:
            # The first turn is complete; further ones end with the time for them.
            if turn and time.perf_counter() - began > budget:
                break
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - start)
            print(name, round(runs[name][-1], 3), file=sys.stderr, flush=True)
    seconds = {name: round(median(found), 3) for name, found in runs.items()}
    total = round(sum(seconds.values()), 3)
    scale = Path(sf_dir).name
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
