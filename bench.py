"""Time the headline queries and print one JSON line.

Every query is written to Spark's no-op sink, so all of its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slabspark.registry import QUERIES  # noqa: E402
from slabspark.session import get_spark  # noqa: E402

HEADLINE = [
    "population_stat", "certificates", "card_views", "workbench_stats", "regions", "quality_gate", "latest_shots",
    "worse_face", "fresh_prices", "grade_upsert", "sync_variants", "near_hash_join", "cosine_top_k", "identify",
    "centroid_distance", "neighbour_distance", "detector_scores", "combined_verdicts", "authenticity_rows",
    "confusion_matrix", "score_distributions", "recommendations", "outlier_fraction", "paired_shift", "track_lock",
    "daily_budget", "stage_durations", "latency_percentiles", "group_key", "text_detector", "page_pairs",
    "cert_payloads", "split_by_cert", "triplets", "reconcile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", master=f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false",
                      spark_driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the JVM paths
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
