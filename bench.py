"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

HEADLINE = [
    "prj_01_parse_events",
    "flt_07_search_files",
    "srt_04_newest_per_device",
    "fn_09_string_hash",
    "jn_01_file_chunks",
    "jn_06_snapshot_diff",
    "jn_08_replicas",
    "jn_11_job_summary",
    "agg_01_windowed_stats",
    "agg_04_fleet_stats",
    "agg_10_dedup_stats",
    "agg_12_series_features",
    "agg_13_series_trend",
    "agg_21_directory_tree",
    "win_01_conflict_winner",
    "win_03_latest_state",
    "win_04_optimal_windows",
    "win_07_quota_consumption",
    "win_08_dirty_trigger",
    "set_01_merge_states",
    "str_02_windowed_stats",
    "str_05_routed_upserts",
    "job_01_fixed_chunks",
    "job_03_content_chunks",
    "job_04_dedup",
    "job_06_best_codec",
    "job_08_erasure_encode",
    "job_09_erasure_rebuild",
    "job_10_distribution",
    "job_11_encryption",
    "job_15_synthetic_full",
    "job_16_restore",
    "job_17_state_replay",
    "ml_01_standardise",
    "ml_09_isolation_forest",
    "ml_10_tenant_distance",
]


def main() -> None:
    from backuplake.plans import load
    from backuplake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(cpus if cpus.isdigit() else 8),
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["agg_03_count_by_status"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
