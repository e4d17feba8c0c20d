"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracelake.registry import all_queries  # noqa: E402
from tracelake.session import build_session  # noqa: E402

HEADLINE = (
    "s1_file_scan", "a4_class_breakdown", "p1_epoch_seconds", "p10_make_events", "w1_activity_bursts",
    "w1_burst_packages", "w2_browsing_sessions", "w3_chain_dedupe", "w6_per_service", "w12_snapshot_deltas",
    "a1_counts_by_axis", "j1_install_state", "j3_clock_summary", "j4_offset_owner", "j5_image_offset",
    "j11_merged_credentials", "j12_type_profile", "j13_compare_summary", "j17_merged_tokens", "j18_leak_audit",
    "j20_first_divergence", "j21_recoverability", "w11_free_runs", "w13_extent_holes", "w15_systematic_sample",
    "x1_literal_search", "x3_hit_report", "x4_signature_scan", "x8_shape_scan", "x10_content_copies",
    "p31_text_strings", "p41_to_ascii", "s4_prefs_rows", "s7_block_rows", "s8_crash_history", "s2_read_body",
    "f8_token_noise", "w14_drop_nested", "v2_check_results",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("tracelake-bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    # One small pass over every table warms files and the JVM, not the queries.
    registered["w4_last_per_source"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
