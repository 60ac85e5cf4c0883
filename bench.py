"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no driver collect).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfspark.plans.registry import QUERIES  # noqa: E402
from shelfspark.session import get_session  # noqa: E402

# Headline queries: every operator family (profile, features, popularity,
# baskets, item-CF, content, hold-out evaluation, serving, ALS and the default
# ALS + neural hybrid) at the bench scale, slow ones included: ``item_cf_topk`` ranks
# *every* customer by item-CF, ``bpr_topk`` makes all 100 iterations and re-ranks.
HEADLINE = [
    "eda_summary", "eda_weekly", "eda_price_histogram", "eda_category",
    "feat_behavioral", "feat_net_demand", "side_features_customer",
    "popular_recency", "popular_recency_by_segment", "popular_trending_by_segment",
    "fbt_lift", "fbt_lift_product", "fbt_confidence", "fbt_cooccurrence",
    "content_topk", "eval_content_based",
    "holdout_test", "eval_popularity_baseline", "serve_personalized", "serve_popular",
    "als_topk", "als_hybrid_topk", "item_cf_topk", "bpr_one_epoch", "rerank_train", "bpr_topk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = get_session(f"local[{cpus}]", app_name="shelfspark-bench", shuffle_partitions=int(cpus) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in only:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
