"""Time the headline queries; prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Every query is
run to a sink that discards its rows; the best of BENCH_RUNS runs counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from codonloom.catalog import registered  # noqa: E402

HEADLINE = (
    "clean_missense", "interaction_degree", "degree_feature", "hypergeometric_test", "enrichment_adjusted",
    "process_flags", "modification_flags", "variant_scores", "label_codons", "training_table",
    "symbol_mapping", "benchmark_table", "undersample_classes", "stratified_folds", "roc_area",
    "threshold_metrics", "model_comparison", "nearest_neighbors",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    queries, seconds = registered(), {}
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.mode("overwrite").format("noop").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(min(took), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
