"""Times the headline queries; prints one JSON line.

Each query is run BENCH_RUNS times (default 3) and its median counts. All rows
are produced; the sink throws them away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from caretally.session import local_session  # noqa: E402
from cases import registry  # noqa: E402

HEADLINE = (
    "patient_max_snapshot", "patient_claim_fanout", "claims_by_payer", "claims_dedup", "revenue_by_payer",
    "revenue_by_quality", "collections_by_vtype", "scorecard_clinic", "scorecard_hospital", "doc_sla", "notes_extract",
    "lag_bucket_pivot", "reviewer_buckets", "lab_outcomes", "encounter_summary", "json_fields", "log_summary",
    "visit_sequence", "conversion_masked", "visits_since_first", "billing_since_first", "billing_totals", "reason_share",
    "scalar_mix",
)


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(registry.queries())
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = registry.queries()
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            queries[name](spark, d).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 3)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"), "runs": runs, "cpus": cpus}
    spark.stop()
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
