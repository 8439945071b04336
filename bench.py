"""Times the headline queries, each the median of three runs after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pacemark.plans.catalog import CATALOG
from pacemark.session import local_session

HEADLINE = [
    "io_total",
    "io_period_changes",
    "period_candidates",
    "period_deadband",
    "controller_combined",
    "policy_compare",
    "tbf_carry_last",
    "telemetry_sliding",
    "run_grouped_median",
    "run_summary",
    "io_summary",
    "pattern_count_file",
    "clean_lines",
    "wordcount",
    "pagerank",
    "terasort_check",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    rows = {
        t: spark.read.parquet(f"{folder}/{t}.parquet").count()
        for t in ("events", "lineitem", "documents")
    }

    def timed(name: str) -> float:
        began = time.monotonic()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.monotonic() - began

    timed("run_summary")  # a query that is not among the slow ones, so that none pays for the start
    times = {name: round(median(timed(name) for _ in range(3)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
