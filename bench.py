"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seslog.plans import load_queries  # noqa: E402
from seslog.session import local_session  # noqa: E402

HEADLINE = (
    "f1_merge_intervals", "f3_overlap_and_peak", "f4_execution_composition", "f9_free_segments", "e9_timing_buckets", "e16_turn_timing", "d5_fork_lineage", "d9_child_to_turn",
    "d11_nearest_context", "d13_tool_tokens_in_response", "h1_session_filter", "h4_offset_page", "h11_record_dedupe", "c7_call_result_pairing", "f8_input_waits",
    "f16_context_of_assistant_message", "g2_trace_assembly", "k1_rule_classification", "e6_tool_context", "b10_data_uri_redaction", "b4_normalized_events", "c3_turn_segmentation",
    "e3_event_type_statistics", "e19_directory_rollup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load_queries()
    wanted = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before the clock
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
