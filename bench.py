"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR is the folder of the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Every query runs completely into the no-op sink; the best of three runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from heliograph.plans.registry import QUERIES  # noqa: E402
from heliograph.session import local_session  # noqa: E402

HEADLINE = (
    "campaign_summary", "fold_email_status", "applied_events", "correlate_events", "correlate_replies",
    "attribute_clicks", "plan_sequence", "draft_context", "select_sendable", "outbound_messages",
    "extract_contact_emails", "rewrite_links", "normalize_drafts", "activity_feed", "route_activity",
    "activity_with_agent", "step_stats", "campaign_counters", "newest_per_group", "latest_snapshot",
    "fold_transcript", "session_summary", "tabulate_submissions", "import_scraped_leads",
    "emails_with_status", "event_counters_from_calls", "stream_email_status", "stream_status_from_calls",
    "stream_applied_events", "stream_campaign_counters", "webhook_health",
)


def seconds(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = local_session(cpus, "heliograph-bench")
    times = {name: round(min(seconds(spark, name, sf) for _ in range(3)), 3) for name in HEADLINE}
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
