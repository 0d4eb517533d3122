"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line with seconds by query, after one warm-up."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ["postings", "lsh_candidates", "search_topk", "search_unseen", "knn_exact", "bucket_stats_rollup", "split_lookup_equiv", "precision_recall_at_k", "tradeoff", "fused_topk", "cache_replay_lru", "insert_batch"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tesserine import catalog

    queries = {}
    for name in HEADLINE:
        for _ in range(2):  # the second time counts: code is compiled and workers are up
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            queries[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
