"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default the sf0.1 tables), BENCH_CPUS (default 8), BENCH_RUNS
(default 3).  Each query runs once to warm up; the median of the runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

NAMES = ["ols_strata", "ols_hc1", "ols_cluster", "ols_moments", "dml_one", "dml_two", "mundlak_one_way", "double_demeaning", "event_study", "bitmap_mundlak", "logit", "poisson", "multinomial", "ridge_cv", "ols_cluster_bootstrap"]


def main() -> None:
    os.chdir(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, os.getcwd())
    from pyspark.sql import SparkSession

    from sumwell.queries import QUERIES

    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in NAMES:
        took = []
        for k in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf).toPandas()
            if k:
                took.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        seconds[name] = round(statistics.median(took), 3)
    spark.stop()
    print(json.dumps({"metric": "regression queries, total of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
