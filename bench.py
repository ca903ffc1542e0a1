"""Time the headline queries: BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.

Prints one JSON line. Every query writes to the no-op sink, so that all rows and columns are
computed and none are sent to the driver.
"""

from __future__ import annotations

import json
import os
import re
import time

from lakewright.operators import profile
from lakewright.session import build_session
from workload import REGISTRY, table

HEADLINE = [
    "join_allow",
    "join_left_count_distinct",
    "join_salted_hot_keys",
    "filter_whole_days",
    "dedup_first",
    "clean_all",
    "numeric_stats",
    "distinct_counts",
    "column_profile",
    "value_counts_topk",
    "histogram",
    "row_number_global",
    "key_ranges_repeated",
    "key_range_counts",
    "sample_systematic",
    "sample_stratified",
    "write_tuned",
    "compact",
    "incremental_stream",
    "explore_describe",
    "profile_report",
    "extract_run",
]


def on_lineitem(operator):
    return lambda spark, folder: operator(table(spark, folder, "lineitem"))


EXTRA = {
    "correlation_lineitem": on_lineitem(profile.correlation_matrix),
    "outliers_iqr_lineitem": on_lineitem(profile.outliers_iqr),
    "describe_lineitem": on_lineitem(profile.describe),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else 8,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: REGISTRY[name].run for name in HEADLINE} | EXTRA
    # Start the session's machinery outside the measured time.
    table(spark, folder, "nation").groupBy("n_regionkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
