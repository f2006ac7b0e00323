"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Protocol: build the bookings table from the star schema once (timed as
``build_bookings``), write it under the checkpoint folder, then run each
headline query warm -- one untimed run, then the median of ``BENCH_REPS``
timed runs of the full result (``write.format("noop")`` forces every row
without collecting it on the driver). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g06_monthly_summary", "g01_kpis", "g08_corr_matrix", "g10_price_histogram", "g13_box_by_room_type",
    "g29_revenue_pivot", "g41_monthly_series", "q05_describe", "q07_cardinality",
    "w02_rolling_stats", "w09_lead_price_curve", "w11_competitor_drop_alerts",
    "e02_elasticity_by_room_type", "e05_arc_elasticity", "n04_strategy_lift", "n05_roi_by_property",
    "p01_complete_requests", "p05_price_context", "b04_greedy_policy", "b05_evaluate_policy",
    "f14_label_encode", "f15_standardize", "c15_clean_table", "k03_segment_profile", "m11_rule_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from ratewise.plans.catalog import load_all
    from ratewise.session import get_spark
    from ratewise.sources.bookings import materialize

    spark = get_spark(f"local[{cpus}]", app="ratewise-bench", shuffle_partitions=int(cpus) * 2,
                      **{"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g"),
                         "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ratewise-bench-")})
    reg = load_all()
    names = [q for q in (only or HEADLINE) if q in reg]

    t0 = time.perf_counter()
    materialize(spark, sf_dir)
    build = time.perf_counter() - t0

    times: dict[str, float] = {"build_bookings": round(build, 3)}
    for name in names:
        fn = reg[name].fn
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(reps):
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
