"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: warm median of 5 runs into the noop
sink, the session's start left out. Prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabulark import get_session  # noqa: E402
from tabulark.plans.catalog import QUERIES  # noqa: E402

HEADLINE = ["flagship", "filter_compare", "sort_top_k", "group_by_all_functions", "join_inner", "join_outer", "merge_left", "join_chain", "drop_duplicates_subset", "unique_values", "column_statistics", "correlation_matrix", "value_counts", "describe_sample", "rolling_mean", "expanding_sum", "rank_average", "fill_interpolate", "pivot_sum", "melt_columns", "update_by_key", "string_functions", "csv_round_trip", "json_round_trip"]


def main():
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        each = []
        for k in range(6):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each), 4)
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


main()
