"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import load  # noqa: E402
from sunward.session import local_session  # noqa: E402

HEADLINES = (
    "d13_frozen_baseline", "a07_counted_report", "a08_pooled_sums", "a09_populations", "a10_complete_hour", "a12_loading_by_expected",
    "a14_dc_loading", "a17_ratio_profiles", "a22_shift_scores", "d01_candidate_features", "d02_threshold_sweep", "d04_matched_strata",
    "d08_timing_study", "d09_ramp_timing", "j04_aligned_build", "j07_meter_intervals", "j08_asof_bounded", "m04_lag_features",
    "m05_origin_features", "m21_block_bootstrap", "q13_channel_stats", "q14_exact_quantiles", "q16_missing_runs", "r04_cell_index",
    "r05_slope_fit", "t04_interval_histogram", "t10_gap_classes", "t20_condition_runs", "x06_sandia", "x15_solar_geometry",
)


def main():
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries = load()
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "sunward-bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{path}/lineitem.parquet").count()
    seconds, failed = {}, {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        start = time.perf_counter()
        try:
            queries[name].run(spark, path).write.format("noop").mode("overwrite").save()
        except Exception as problem:
            failed[name] = f"{type(problem).__name__}: {str(problem)[:200]}"
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    line = {"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
            "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
