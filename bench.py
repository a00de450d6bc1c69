"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodgecast.queries.bound import QUERIES
from lodgecast.session import clear_scratch, local_session, scratch_scope

HEADLINE = [
    "bookings_view",
    "booking_features",
    "imputation_stats",
    "dedupe_bookings",
    "preprocess_bookings",
    "build_scoring_table",
    "score_requests",
    "flag_by_threshold",
    "split_stratified",
    "evaluate",
    "batch_metrics",
    "lift_at_share",
    "segment_cancel_rate",
    "client_aggregates",
    "feature_drift",
    "train_model",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query pays for starting the JVM and loading classes.
    QUERIES["booking_features"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        with scratch_scope(spark):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    spark.stop()
    result = {
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
