"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice; the faster run is reported, so code generation and JIT warm-up of a
fresh JVM do not hide the plan. The first runs are listed under "first".
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from userprism.plans.queries import QUERIES  # noqa: E402
from userprism.session import local_session  # noqa: E402

HEADLINE = (
    "dedup", "rare_bucket", "numeric_stats", "heavy_user_quantiles", "cond_counts", "wide_counts",
    "cond_sums", "distinct_per_user", "conversion_counts", "count_summary", "category_lift",
    "overlap_report", "outlier_users", "target_corr", "json_flatten", "rank_auc",
    "event_features", "attribution_features", "position_features", "training_table", "tree_auc",
    "exploration_features", "corr_filter", "gbt_auc", "delimited_read", "sparse_positions", "typed_counts",
)


def run(spark, name, sf_dir):
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "userprism-bench", shuffle_partitions=cpus)
    names = sys.argv[1:] or HEADLINE
    run(spark, "rows_per_user", sf_dir)  # start the engine
    first, times = {}, {}
    for name in names:
        first[name] = run(spark, name, sf_dir)
        times[name] = min(first[name], run(spark, name, sf_dir))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "first": first,
                "first_total": round(sum(first.values()), 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
