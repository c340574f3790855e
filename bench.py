"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds, each query run once after a warm-up."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ("flagship_wakes", "canonical_events", "fanout_multi_rule", "debounce_full", "cooldown_batches", "ring_dedup", "immediate_batches")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vigil.registry import QUERIES

    run = lambda n: QUERIES[n](spark, d).write.format("noop").mode("overwrite").save()
    run("event_key")
    took = {}
    for n in HEADLINE:
        t = time.time()
        run(n)
        took[n] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
