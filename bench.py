"""Headline queries at one scale, as one JSON line: ``BENCH_SF_DIR``, ``BENCH_CPUS``."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "agg_class_num_stats",
    "agg_class_cat_topk",
    "agg_bin_num_stats",
    "split_stratified",
    "knn_topn",
    "knn_balanced_multi",
    "knn_embeddings",
    "render_cases",
    "corpus_full",
    "verdict",
    "verdict_counts",
    "metrics_multiclass",
    "clean_encounters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        # long generated methods are not compiled by the JVM; below this size they are split up instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # small inputs, costly rows: keep every core busy after a shuffle
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import QUERIES

    spark.read.parquet(f"{folder}/orders.parquet").count()
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
