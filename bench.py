"""Prints one JSON line with the seconds of each headline query, warm."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ["replay_totals", "replay_topn", "split_stats", "wire_frames_exact", "resolve_identity", "whole_doc_dedup", "buckets_by_path", "turn_counters", "lru_prune", "cdc_dedup", "structural_split", "json_spans"]


def main() -> None:
    from pyspark.sql import SparkSession

    from turnfold.plans.registry import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, saved = {}, {}
    for name in HEADLINE:
        for _ in range(2):  # the first compiles
            t = time.perf_counter()
            rows = QUERIES[name](spark, sf)
            if name == "replay_totals":
                saved = rows.first().asDict()
            else:
                rows.write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "replay": saved}))


if __name__ == "__main__":
    main()
