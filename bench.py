"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from quirelake.plans import registry
from quirelake.session import local_session

try:
    from quirelake.llm import queries as llm
except ImportError as e:  # the library works without that subpackage
    if not (e.name or "").startswith("quirelake.llm"):
        raise
    llm = None

HEADLINE = (
    "cap_count_by_venue", "cap_trend", "cap_cooccurrence", "cap_search_page", "dash_summary", "dash_venues", "dash_completeness", "quality_issues_by_kind", "win_canonical_record",
    "er_memberships", "fts_all_terms", "topic_assignments", "vector_nearest", "match_reconcile", "p5_found", "p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "p7_found", "p8_ids", "p9_mixture", "p10_found",
)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    every = registry.queries() | (llm.queries() if llm else {})
    out = tempfile.mkdtemp(prefix="quirelake-bench-")
    times: dict[str, float] = {}
    every["dash_years"](spark, d).write.mode("overwrite").parquet(f"{out}/warm-up")
    for name in HEADLINE:
        if name in every:
            begun = time.time()
            every[name](spark, d).write.mode("overwrite").parquet(f"{out}/{name}")
            times[name] = round(time.time() - begun, 3)
            spark.catalog.clearCache()
    shutil.rmtree(out, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": d.rstrip("/").rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
