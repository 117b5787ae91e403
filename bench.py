"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from tessera.plans import registry
from tessera.session import session

NAMES = ("entry_revenue_by_nation", "agg_group", "join_five_way", "join_self_equi_count", "win_rows", "win_groups", "sort_top_k", "set_intersect", "agg_distinct", "bench_point", "bench_range_count", "bench_self_join", "bench_group_by", "correlated_group_max")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["agg_group"](spark, sf).collect()
    for name in NAMES:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
