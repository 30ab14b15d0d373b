"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from cellweave.plans import catalog

HEADLINE = ("align_lls", "centrality_pr", "top_hub", "diff_pr", "network_stats", "deconvolute", "find_all_hub", "find_diff_hub", "lls_benchmark", "normalize_log", "cluster_specificity", "pseudobulk")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalog.QUERIES["top_hub"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder}))


if __name__ == "__main__":
    main()
