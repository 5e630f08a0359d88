"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs
once to warm up and then ``BENCH_RUNS`` times; the best time counts. The rows are
produced in full (``noop`` sink), not fetched.
"""

from __future__ import annotations

import json
import os
import time

from goldrec.queries import QUERIES
from goldrec.session import local_session
from goldrec.sources import fixtures

HEADLINE = (
    "valid_requests",
    "idem_classify",
    "dedup_event_id",
    "golden_record",
    "golden_upsert",
    "golden_trace",
    "field_conflicts",
    "mastered_events",
    "match_email_exact",
    "match_score",
    "best_match",
    "dlq_events",
    "dlq_alerts",
    "latency_quantiles",
    "slo_status",
    "slo_by_window",
    "alert_error_rate",
    "alert_latency",
    "event_rate",
    "list_customers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    events = fixtures.table(spark, sf_dir, "events").count()
    seconds = {}
    for name in names:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            if attempt:
                best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 4)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
        "warm": True,
        "input_events": events,
    }
    if "golden_record" in seconds:
        out["golden_events_per_sec"] = round(events / seconds["golden_record"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
