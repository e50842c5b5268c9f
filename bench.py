"""Headline-query benchmark: one JSON line with per-query wall seconds.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Each query is executed once to warm up, then timed; results are consumed by
the ``noop`` sink so the full plan runs without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedpulse.plans import registry  # noqa: E402
from feedpulse.session import build_session  # noqa: E402

HEADLINE = [
    "trend_daily", "topic_growth", "product_stats", "weekly_drift", "describe_ratings", "rating_kde",
    "insights", "clean_trend_documents", "tfidf", "fit_vocab_email", "split_stratified", "apply_index",
    "increase_1h", "histogram_quantile_p95", "offset_delta", "alert_states", "alert_inhibit",
    "stream_trend_daily", "alert_routes", "alert_groups", "stream_rates_5m",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="feedpulse-bench", shuffle_partitions=int(cpus) * 2)
    registry.load_all()
    times = {}
    for name in names:
        fn = registry.QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
