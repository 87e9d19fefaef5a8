"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NAMES = ("asof_users_by_event", "bitemporal_slice", "timeline_buckets", "list_edges_filtered", "match_customer_order_part", "walk_depth3", "journey_users", "shortest_hops", "pagerank_k5", "degree_in_out", "bm25_topk", "knn_cosine", "rrf_fusion", "portion_supersede", "bulk_subtract", "change_feed_page", "granted_set", "page_links")


def main() -> None:
    from pyspark.sql import SparkSession

    from tesserae.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and warms
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries, second run", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
