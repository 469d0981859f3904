"""Time the headline queries and print one JSON line.

Tables are built in the order a full refresh builds them, then the page queries run on them.
Every figure is the median of the timed runs after warm-up runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from registry import marts as M
from registry.queries import QUERIES
from trackline.session import configure

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
WARMUPS = int(os.environ.get("BENCH_WARMUPS", "1"))

BUILDS = ["value_periods_all_signals", "position_periods", "acc_periods",
          "timeline_carry_forward", "sector_lookup", "lap_facts", "wind_facts"]
PAGES = ["event_order_in_lap", "consistency_audit", "driver_consistency", "race_summary",
         "lap_box_stats", "vehicle_performance", "speed_histogram", "gear_usage", "racing_line",
         "lap_progression", "filtered_histograms", "lap_summary", "lap_detail", "best_lap",
         "cumulative_distance", "braking_points", "quantile_class", "wind_rose_stack",
         "wind_timeline_vectors"]


def consume(df: DataFrame) -> None:
    """Compute every column of every row without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def timed(spark: SparkSession, name: str) -> float:
    run = QUERIES[name].spark
    for _ in range(WARMUPS):
        consume(run(spark, SF_DIR))
    seconds = []
    for _ in range(RUNS):
        started = time.perf_counter()
        consume(run(spark, SF_DIR))
        seconds.append(time.perf_counter() - started)
    return round(statistics.median(seconds), 3)


def main() -> None:
    spark = (
        configure(SparkSession.builder)
        .master(f"local[{CPUS}]")
        .appName("trackline-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    tables = M.open_marts(spark, SF_DIR)
    for table in ("periods", "position", "acc", "timeline", "placed", "audit_placed", "laps", "wind"):
        getattr(tables, table)
    refresh = round(time.perf_counter() - started, 3)
    queries = {name: timed(spark, name) for name in BUILDS + PAGES}
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "first_full_refresh": refresh,
                "runs": RUNS,
                "cpus": CPUS,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
