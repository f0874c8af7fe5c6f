"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and threads."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main() -> None:
    from gridpanel.plans.catalogue import QUERIES

    spark, took = session(), {}
    for name, query in QUERIES.items():
        times = []
        for _ in range(RUNS + 1):  # the first run warms up
            began = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "median of warm runs, summed over queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(SF_DIR).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
