"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Every query runs once to
warm up code and file cache and is then timed; the result is fully computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from genoweave import local_session  # noqa: E402
from genoweave.registry import load  # noqa: E402

HEADLINE = (
    "X3_clinical_report", "X4_route_triage", "G3_multiallelic_split", "F10_phasing_eligibility", "F14_changed_span_in_genes", "J7_cds_overlap", "J12_asof_join",
    "A24_merge_half_open", "A22_gene_relation", "A15_template_site_counts", "A39_template_depth", "A12_interval_depth",
    "X7_copy_number_follow_up", "A27_ablation", "A29_raw_sums", "A34_track_comparison",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, max(cores, 8))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        for attempt in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt:
                times[name] = round(took, 3)
            print(f"{name} {took:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
