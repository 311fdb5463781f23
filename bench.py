"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

    python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from callscope.plans import queries
from callscope.session import get_spark

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "minute_features",
    "tenant_summary",
    "traffic_panels",
    "dashboard_summary",
    "recent_logs",
    "log_retention",
    "supervised_windows",
    "forecast_baseline_metrics",
    "route_resolution",
    "admission_audit",
    "token_bucket_replay",
    "token_bucket_replay_hot",
    "impute_standardise",
    "lof_scores",
    "isolation_forest",
    "labelled_windows",
    "clean_documents",
    "chunk_documents",
    "redaction",
    "question_routing",
    "vector_topk",
    "context_budget",
    "stream_minute_features",
    "stream_token_bucket",
)


def run(fn, spark) -> float:
    """Seconds to plan and compute every row of a query, without collecting any."""
    start = time.perf_counter()
    fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = get_spark("bench", CPUS)
    known = queries()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(known[name], spark)  # warm-up: code generation, file listing, Python workers
        times[name] = round(run(known[name], spark), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "warm_wall_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
