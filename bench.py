"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from factmill.plans import catalog
from factmill.sources.tables import store_chunked

HEADLINE = [
    "q07_and", "q10_dnf", "q12_logic_bomb", "q13_box", "q14_prefix", "q17_tags_exact", "q21_semi_and", "q22_triple",
    "q24_anti", "q25_or_semi", "q28_agg_sum", "q34_set_ops", "q35_descendants", "q36_descendants_cycle", "q40_reach", "q42_three_strata",
    "q44_three_hop", "q46_const_and_multi_edb", "q47_incremental", "q70_objects", "q72_long_chain", "q73_complete_graph",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds = {}
    # the skipping query alone, over a table and summary that are stored beforehand
    rows, summary = store_chunked(catalog._tagged(spark, sf_dir), tempfile.mkdtemp(prefix="bench-skip-"), catalog.CHUNK)
    queries["q19_over_stored"] = lambda spark, sf_dir: catalog.skip_query(rows, summary)
    for name in [*HEADLINE, "q19_over_stored"]:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
