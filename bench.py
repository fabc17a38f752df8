"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, or ``all``).
Every query runs to completion into a no-op sink after one warm-up pass of the
flagship query; building the DataFrame counts, because some operators checkpoint.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proofline import plans  # noqa: E402
from proofline.session import build_session, drop_scratch  # noqa: E402

HEADLINE = (
    "a04_interval_union", "a05_rank_tracks", "a06_coverage_ratio", "a09_first_success", "a12_select_formats", "a14_even_sample",
    "b02_tree_digest", "b03_manifest_diff", "b05_reference_audit", "b08_binding_audit", "b09_chain_audit", "b13_contiguous_sequence",
    "b22_budget_audit", "b24_gate_order_audit", "b26_artifact_lineage", "b28_claim_rollup", "b36_value_domain_audit",
    "c02_step_motion", "c05_cycle_candidates", "c07_collapse_near_duplicates", "c08_robust_outliers", "c09_region_overlap",
    "c10_nearest_timestamp", "c11_bracket_lookup", "c24_dominant_bin", "c25_nearest_center",
    "d01_binary_scores", "d05_weighted_score", "d07_release_regressions", "d09_threshold_gates",
    "e03_word_budget", "e07_markup_safety", "e11_sensitive_scan", "e13_repeat_collapse_candidates",
    "f01_task_waves", "f02_transition_log_audit", "f03_checkpoint_fold", "f05_change_scope",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    known = plans.queries()
    names = list(known) if wanted == "all" else [n for n in wanted.split(",") if n in known]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "256k"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    known["a04_interval_union"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    drop_scratch(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
