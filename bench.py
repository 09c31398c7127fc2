"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each is run $BENCH_REPEATS times (once by default) and its median counts; with more than one, a run before them warms up.
"""

import json
import os
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

from tallymark.plans.catalog import QUERIES
from tallymark.session import configure

HEADLINE = [
    "numeric_summary", "histogram", "frequency_table", "duplicate_rows", "correlate", "distribution_shift", "chi_square",
    "density_grid", "level_shift", "group_mean_difference", "provenance", "structure_report", "date_summary",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g"))
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times, repeats = {}, int(os.environ.get("BENCH_REPEATS", "1"))
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        took = []
        for _ in range(repeats + (repeats > 1)):
            started = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - started)
        times[name] = round(median(took[-repeats:]), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
