"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores. Every query is fully
evaluated into Spark's no-op sink; one small query warms the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from structpeak.queries import QUERIES  # noqa: E402
from structpeak.session import local_session  # noqa: E402

HEADLINE = (
    "annual_window_peak", "gap_fill", "robust_scaler", "fixed_windows", "window_alignment", "registry_alignment",
    "window_channels", "contaminated_windows", "sampled_group_windows", "structural_peak_fixed_weights",
    "code_limit_losses", "fitted_structural_peak", "fitted_multichannel_peak", "refitted_peak_h1", "raw_quantiles", "soft_peak", "hampel_maximum", "sustained_maximum",
    "segment_votes", "calibrated_h1", "calibration_metrics", "bootstrap_hit_rate", "signed_rank_test", "global_price_ranks",
    "merge_h0", "network_length", "price_interval_join", "job_cost_report",
)


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    run(spark, "raw_maximum", sf)  # start-up and code generation
    seconds = {n: round(run(spark, n, sf), 3) for n in names}
    spark.stop()
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "cores": cores,
    }))


if __name__ == "__main__":
    main()
